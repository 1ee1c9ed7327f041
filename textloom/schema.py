"""The tables of a memory."""

VERSION = 1

CHUNKS = "id bigint, text string, source string, page int, offset int, length int, frame int, embedding array<float>"
METADATA = "key string, value string"
CHUNK_META = "id bigint, frame int, length int, created_at timestamp, updated_at timestamp, metadata map<string,string>, importance double, tags array<string>"
FRAMES = "frame int, chunk_id bigint, payload string, compressed boolean, encoded_size int"
