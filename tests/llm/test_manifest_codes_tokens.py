"""Merkle manifest, vector codes and token files against plain versions, on odd tables, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm import merkle, registry, token_file, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and each leaf's siblings level by level with the number before it."""
    paths, row, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(row) > 1:
        for p, i in zip(paths, at):
            run = row[i // 16 * 16 : i // 16 * 16 + 16]
            p.append((run[: i % 16], run[i % 16 + 1 :]))
        row, at = [sha(*row[i : i + 16]) for i in range(0, len(row), 16)], [i // 16 for i in at]
    return row[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *plain_tree([leaf(r) for r in own])
    root, tops = plain_tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lower(r[4]))) if hit else leaf(r)
            for before, after in path + top:
                node = sha(*before, node, *after)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for b, a in path + top for x in b + a)), node, node == root))
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("source", "lang")), T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("key", "node", "path", "i", "changed", "leaf", "label", "block"))])


def documents(spark, rows, tmp_path):
    spark.createDataFrame([(*r, *"zzzzzzzz") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def odd_rows():
    rng = random.Random(1)
    rows = [(i, "big", rng.choice(["en", None]), i % 90, f"Text {i} " * (i % 7)) for i in range(700)]  # three levels, more than two blocks
    rows += [(i, rng.choice([None, "", "a", "é", "zz", "\U0001f600"]), "en", None, rng.choice([None, "", "ABC", "é" * 50])) for i in range(700, 760)]
    rows += [(None, "a", None, None, None)] * 2 + [(None, "a", None, 1, "x"), (705, "a", "en", 3, "twice"), (705, "a", "en", 3, "twice"), (9, "lone", "en", 1, "A" * 200_000)]
    return rows + [(1000 + k, f"src{k}", "en", k, "Some") for k in range(40)]  # several sources, two levels of them


def test_manifest(spark, tmp_path):
    rows = odd_rows()
    got = registry.op11_merkle_manifest(spark, documents(spark, rows, tmp_path))
    got = [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[(5, None, None, None, "Text")], [(5, "a", "en", 1, "Text"), (6, "b", "en", 1, None)], [(k, "a", "en", 1, "T") for k in range(17)], [(1, "a", "en", 2, "B")] * 300])
def test_small_manifests(spark, tmp_path, rows):
    got = [tuple(r) for r in registry.op11_merkle_manifest(spark, documents(spark, rows, tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got) == sorted(plain_manifest(rows))


def test_manifest_of_nothing(spark, tmp_path):
    assert registry.op11_merkle_manifest(spark, documents(spark, [], tmp_path)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_traversal(n):
    nodes, height = [sha(str(i)) for i in range(n)], merkle.levels(n)
    root, paths = plain_tree(nodes)
    assert merkle.block_root(nodes, height) == root
    for i, runs in enumerate(merkle.traversed(nodes, height)):
        assert [(r[: i // 16**k % 16], r[i // 16**k % 16 + 1 :]) for k, r in enumerate(runs)] == paths[i]


def test_traversal_keeps_little():
    nodes = [sha(str(i)) for i in range(16**3)]
    most, tree = 0, merkle.Treehash(2)
    for x in nodes[:256]:
        tree.push(x)
        most = max(most, sum(map(len, tree.stacks)))
    assert most <= 3 * 16


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Plain integers throughout: (vec_id, code, error, label) and the codebooks."""
    import math

    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[tuple(v[p * w : p * w + w]) for _, v, _ in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                x = v[p * w : p * w + w]
                got.setdefault(best(x, books[p])[1], []).append(x)
            books[p] = [tuple(sum(c) // len(c) for c in zip(*got[k])) if k in got else e for k, e in enumerate(books[p])]
    found = [(i, [best(v[p * w : p * w + w], books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), lab) for i, f, lab in found], text


def vector_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=32).astype(np.float32).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(n)]
    rows += [(7, rows[0][1], 1), (7, rows[0][1], 1), (None, rows[1][1], None), (900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [float("nan"), *rows[0][1][1:]], 1), (903, [float("-inf"), *rows[0][1][1:]], 1), (904, [], 2)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, v string, codes string, keep0 string, name string"


@pytest.mark.parametrize("n", [200, 40])
def test_codes(spark, tmp_path, n):
    rows = vector_rows(n)
    spark.createDataFrame([(*r, *"zzzz") for r in rows], VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.op12_vector_codes(spark, str(tmp_path)).collect()
    want, books = plain_codes(rows)
    total = {lab: sum(e for _, _, e, x in want if x == lab) for *_, lab in want}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, e, total[lab]) for i, c, e, lab in want), key=str)
    assert {r.codebooks_sha256 for r in got} == {sha(books)} and len(got) == n + 3


def test_codes_of_nothing_and_of_bad_lengths(spark):
    rows = spark.createDataFrame([(1, None), (2, [float("nan")] * 16)], "vec_id long, embedding array<float>")
    assert vector_codes.compress(rows).rows.count() == 0 and vector_codes.compress(rows.limit(0)).rows.count() == 0
    for bad in ([(1, [1.0] * 15)], [(1, [1.0] * 16), (2, [1.0] * 32)]):
        with pytest.raises(Exception, match="one length"):
            vector_codes.compress(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="refused"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16)], "vec_id long, embedding array<float>"))


def test_decoded_vectors_are_near(spark):
    rows = vector_rows(300)
    found = vector_codes.compress(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>"))
    by_id = {i: v for i, v, _ in rows if v}
    off = [np.square(vector_codes.decoded(r.codes, found.books) - by_id[r.vec_id]).mean() for r in found.rows.where("vec_id < 300 and vec_id <> 7").collect()]
    assert np.mean(off) < 0.25  # of a variance of 1, with 64 entries for each two dimensions


def test_packed_ids_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_file.packed(v)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in v)
        assert (token_file.unpacked(control, data, n) == v).all()


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, " lead", "trail \n", "it's 12 o'clock", "É é ́x", "a\x1cb\x85c d e", "ΟΔΟΣ ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "日本語 テスト", "1 11 1.1", "\U0001f600\U0001f601!", "İstanbul ŒUVRE ﬁne",
         "a‍b", "don't,stop", "﻿bom", "Ångström", "<|ENDOFTEXT|>", "'s 's", "a̸ ≯", "　ideo　", "word " * 3000, "\t\v\f", "q̣̇ q̣̇"]


def test_words_give_whole_texts_ids():
    rng = random.Random(5)
    alphabet = "ab A1'.,<>|é́\n\t\x0b\x0c\x1c\x85 Σσ日ö‍$"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words = token_file.WordIds(WORDS)
    ids, size = words.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(size)])
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_token_files(spark, tmp_path):
    rows = [(i, "en", "a", 1, t) for i, t in enumerate(TEXTS)] + [(None, "en", "a", 1, "no id"), (3, "en", "a", 1, "again"), (4, "en", "a", 1, TEXTS[4]), (99, "en", "a", 1, "long " * 150_000)]
    rows = [(r[0], r[2], r[1], r[3], r[4]) for r in rows]
    got = registry.op13_token_ids(spark, documents(spark, rows, tmp_path)).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*plain_ids(r[4]), 1])
    assert len(got) == len(rows)
    done = 0
    for r in sorted(got, key=lambda r: r.start):
        mine = next(x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and len(x) == r.n_tokens)
        ids[r.doc_id].remove(mine)
        assert r.start == done
        done += len(mine)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_files_kept_in_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * i) for i in range(50)], "doc_id long, text string")
    token_file.write(docs, WORDS, f"{tmp_path}/tokens", end=7)
    files = token_file.TokenFiles.at(spark, f"{tmp_path}/tokens")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in files.rows().collect()}
    assert got == {i: [*plain_ids("the cat sat on the mat " * i), 7] for i in range(50)}
    assert files.ranks.orderBy("rank").first().id == plain_ids("the")[0]
    size = files.segments.agg(F.sum(F.octet_length("block"))).first()[0]
    assert size < 13 * 50 + 1.3 * sum(map(len, got.values())) + 200


def test_token_files_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_file.write(empty, WORDS).rows().count() == 0
