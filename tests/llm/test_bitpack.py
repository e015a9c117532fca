import zlib

import numpy as np
import pytest
from brute import HARD
from tokenizers import Tokenizer

from formlake.llm import bitpack
from formlake.llm.tokens import public_path

PATH = public_path("word_bpe_49k.json")


@pytest.mark.parametrize("width", range(1, 33))
def test_fields_of_every_width(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    raw = bitpack.pack(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    data = np.frombuffer(raw + b"\0" * 8, np.uint8)
    assert (bitpack.unpack(data, width, 0, 1001) == ids).all()
    assert (bitpack.unpack(data, width, 317, 40) == ids[317:357]).all()


def test_width_is_the_least():
    assert [bitpack.width_of(n) for n in (1, 2, 3, 256, 257, 32_000, 49_408)] == [1, 1, 2, 8, 9, 15, 16]


def expected(rows):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in order]


def check(df, rows, **more):
    got = bitpack.packed_documents(df, PATH, 1, **more).orderBy("start").collect()
    want, start = expected(rows), 0
    assert [r.doc_id for r in got] == [i for i, _ in want]
    by_id = {}
    for i, ids in want:
        by_id.setdefault(i, []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        by_id[r.doc_id].remove(r.ids_crc32)
    assert start == sum(len(ids) for _, ids in want)


def test_documents(docs, table):
    rows = table("documents", "doc_id", "text")
    check(docs(rows), rows)
    check(docs(rows), rows, vocabulary=100_000)  # 17 bits


def test_hard_rows_and_no_rows(docs):
    check(docs(HARD), HARD)
    assert bitpack.packed_documents(docs([]), PATH, 1).count() == 0


def test_random_access(spark, docs, table, tmp_path):
    rows = table("documents", "doc_id", "text")
    path = f"{tmp_path}/packed"
    bitpack.write_packed(docs(rows).coalesce(1), f"file://{path}", PATH, 1, vocabulary=60_000, block_tokens=500)
    flat = {i: ids for i, ids in expected(rows)}
    seen = 0
    for file in spark.read.format("binaryFile").load(f"file://{path}").collect():
        if not file.content:
            continue
        reader = bitpack.PackedFile(bytes(file.content))
        own = np.array([t for d, _, _ in reader.documents() for t in flat[d]], np.uint32)
        seen += len(own)
        assert len(reader.blocks) > 1
        for first, n in ((0, 10), (490, 30), (len(own) - 5, 5), (len(own) // 2, 2000), (3, 0)):
            assert (reader.tokens(first, n) == own[first:first + n]).all()
    assert seen == sum(map(len, flat.values()))


@pytest.mark.parametrize("block_tokens, file_bytes", [(300, 2000), (1, 1 << 30), (1, 1)])
def test_files_of_bounded_size(spark, docs, table, tmp_path, block_tokens, file_bytes):
    """Files closed by their bytes, by their number of blocks and after every block, read back as one table."""
    rows = table("documents", "doc_id", "text")
    rows += [(10**6 + i, "w") for i in range(3000)]
    path = f"file://{tmp_path}/packed"
    bitpack.write_packed(docs(rows).coalesce(1), path, PATH, 1, block_tokens=block_tokens, file_bytes=file_bytes)
    files = [bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect() if f.content]
    readers = [bitpack.PackedFile(f) for f in files]
    assert len({r.blocks[0][2] for r in readers}) == len(readers) > 3
    for content, reader in zip(files, readers, strict=True):
        assert len(reader.blocks) <= bitpack.FILE_BLOCKS and int(reader.offsets[-1]) < file_bytes + 1
        assert content.endswith(b"\n")
    got = bitpack.read_packed(spark, path).orderBy("start").collect()
    want, start = expected(rows), 0
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
