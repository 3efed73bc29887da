"""Token counts, Merkle manifests and vector codes against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import merkle, token_counts, vector_codes
from loomtext.llm._frames import table
from loomtext.llm.queries import op11_token_counts, op12_merkle_manifest, op13_filtering_lloyd

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def lengths(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def compiled():
    with open(FILE, "rb") as f:
        return token_counts.CompiledTokenizer(f.read(), token_counts.code_point_classes(FILE))


def counted(compiled, texts):
    return compiled.count([t.encode() for t in texts]).tolist()


def test_counts_of_odd_texts(compiled):
    texts = ["", "a", " ", "  ", "\n\n x", "  x", "\t x", " \t\n", "'s", "''s", "a's", "a 's", "I'll we've you're it'd 'LL 'rx 're", "'r", "'l", "a'", "don't<|endoftext|>ok<|endoftext|>", " <|endoftext|> x", "<|endoftext", "<|endoftext|"]
    texts += ["a" * 1000, " " * 500, "-" * 300, "ab" * 999, "é" * 300, "\U0001f600" * 50, "日本語のテキスト" * 40]
    assert counted(compiled, texts) == lengths(texts)


def test_counts_of_random_texts(compiled):
    rng = random.Random(1)
    signs = ["'", "s", "r", "e", "v", "l", "t", "m", "d", " ", "\n", "\t", "x", "1", "é", "!", ".", " ", "日", "<|endoftext|>", "́", "Q"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(6)) for _ in range(3000)]
    tokens = [LIBRARY.decode([k]) for k in range(50256)]
    texts += ["".join(rng.choices(tokens, k=3)) for _ in range(5000)]
    texts += ["".join(rng.choices("abcdeo", k=rng.randint(200, 3000))) for _ in range(50)]  # pieces over many chunks
    texts += ["a" * k for k in range(60, 700, 7)]  # chunks whose guessed state is wrong
    assert counted(compiled, texts) == lengths(texts)


def test_every_token_counts_one_and_seams_are_judged_right(compiled):
    v = compiled.counter.vocabulary
    texts = [LIBRARY.decode([k]) for k in v.right]
    whole = [(k, t) for k, t in zip(v.right, texts, strict=True) if "�" not in t]
    rng = random.Random(2)
    for (x, a), (y, b) in (rng.choices(whole, k=2) for _ in range(3000)):
        if a.isalpha() and b.isalpha() and a.isascii() and b.isascii():  # one piece
            assert v.apart(x, y) == ([e for e in LIBRARY.encode(a + b).ids] == [x, y])


def test_maps_of_chunks_compose(compiled):
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 6, (37, 6))
    scanned, now = token_counts.compose(maps), np.arange(6)
    for k, m in enumerate(maps):
        now = m[now]
        assert (scanned[k] == now).all()
    assert compiled.splitter.horizon <= 4


def test_counts_with_a_small_table_and_slices(compiled, monkeypatch):
    texts = [" ".join("".join(random.Random(k).choices("abcdefgh", k=5)) for k in range(n, n + 40)) for n in range(0, 400, 40)]
    counter = token_counts.Counter(compiled.counter.vocabulary, states=300)  # started again many times
    monkeypatch.setattr(compiled, "counter", counter)
    monkeypatch.setattr(token_counts, "BLOCK", 500)  # longer texts are cut
    texts += ["".join(texts), "x'll " * 900, "a" * 3000, "é \n" * 700]
    assert counted(compiled, texts) == lengths(texts)


def test_counts_of_documents(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = op11_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(texts.items(), lengths(list(texts.values())), strict=True)}
    rows = [(None, None, 1), (2, "", 2), (2, "", 2), (3, "word " * 200_000, 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int")
    got = token_counts.count_tokens(odd, FILE)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.n_bytes, r.n_tokens) for r in got.collect()) == [(0, 0), (0, 0), (0, 0), (1_000_000, lengths([rows[3][1]])[0])]
    assert token_counts.count_tokens(odd.where("false"), FILE).count() == 0


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, place):
    for nodes in tree[:-1]:
        other = place ^ 1
        yield nodes[other] if other < len(nodes) else None, place % 2 == 1
        place //= 2


def manifest(rows):
    encode = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = collections.defaultdict(list)
    for r in rows:
        more = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        leaf, other = (h(*(encode(x[c]) for c in COLUMNS)) for x in (r, r | {"n_chars": r["n_chars"] + 1} if more else r))
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, other, r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(by[x])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for k, x in enumerate(langs):
        for place, (*_, leaf, other, doc_id) in enumerate(sorted(by[x])):
            path, folded = [*way(trees[x], place), *way(top, k)], other
            for sibling, left in path:
                folded = h(folded) if sibling is None else h(sibling, folded) if left else h(folded, sibling)
            yield doc_id, leaf, trees[x][-1][0], top[-1][0], h("".join(s or "" for s, _ in path)), folded, folded == top[-1][0]


def tampered():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def test_manifest_of_documents(spark):
    rows = [r.asDict() for r in table(spark, SF, "documents").collect()]
    got = op12_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(manifest(rows))


@pytest.mark.parametrize("depth", [1, 8])
def test_manifest_of_odd_tables(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "BLOCK", 1 << depth)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "a", ""]), rng.choice([None, "", "x", "é", "￿", "\U00010000"]) if k % 3 else "hot", rng.choice([None, 5]), rng.choice([None, "", "t é"]), k % 2) for k in range(330)]
    rows += [(7, "s", "hot", 3, "same", 0)] * 70 + [(8, None, "hot", 9, "long " * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, node int")
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in merkle.manifest(docs, tampered=tampered()).collect()]
    assert sorted(got, key=key) == sorted(manifest([r.asDict() for r in docs.collect()]), key=key)


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 2, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in merkle.manifest(docs, tampered=tampered()).collect()] == list(manifest([r.asDict() for r in docs.collect()]))
    assert merkle.manifest(docs.where("false")).count() == 0
    assert all(r.verified for r in merkle.manifest(docs).collect())


def lloyd(rows):
    """rows: (id, label, vector), sound ones of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(rows[0][2]) // 4)
    x = np.zeros((len(rows), 4 * width), np.int64)
    x[:, : len(rows[0][2])] = np.floor(np.array([r[2] for r in rows]) * 1024)
    x = x.reshape(len(rows), 4, width)
    books = x[:256].transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(4):
        for p in range(4):
            at = near(p).argmin(axis=1)
            for e in np.unique(at):
                books[p][e] = x[at == e, p].sum(axis=0) // (at == e).sum()
    codes = np.stack([near(p).argmin(axis=1) for p in range(4)], axis=1)
    error = sum(near(p).min(axis=1) for p in range(4))
    by = collections.Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        by[r[1]] += e
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), e, by[r[1]], digest) for r, code, e in zip(rows, codes.tolist(), error.tolist(), strict=True)]


def test_codes_of_embeddings(spark):
    rows = [(r.vec_id, r.label, [float(v) for v in r.embedding]) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got = op13_filtering_lloyd(spark, "/root/testdata/sf0.01").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(lloyd(rows))


@pytest.mark.parametrize("scale", [1.0, 3000.0])  # the larger one needs whole numbers of 64 bits
def test_codes_of_odd_tables(spark, scale):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(0, 1, (400, 6)), 1) * scale  # many ties; 4 doesn't divide the length
    sound = [(int(k) if k % 50 else None, None if k % 9 == 0 else int(k % 3), v.tolist()) for k, v in enumerate(values)] + [(5, 1, values[5].tolist())] * 3
    bad = [(1, 0, None), (2, 0, []), (3, 0, [None] * 6), (4, 0, [float("nan")] * 6), (6, 0, [float("inf")] * 6), (7, 0, [1.0] * 4)]
    df = spark.createDataFrame(sound + bad, "vec_id long, label int, embedding array<double>").withColumn("CODE", F.lit(1)).repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=key) == sorted(lloyd(sound), key=key)
    assert vector_codes.compress(df.where("false")).count() == 0
    assert [r.code for r in vector_codes.compress(df.where("vec_id = 9")).collect()] == ["00000000"]


def test_boxes_assign_whole_subtrees():
    rng = np.random.default_rng(6)
    centres = rng.integers(-5000, 5000, (16, 4))
    points = centres[rng.integers(0, 16, 6000)] + rng.integers(-20, 20, (6000, 4))
    tree = vector_codes.Tree.build(points)
    whole, places, _ = tree.filtered(centres)
    assert len(places) < 600 and sum(tree.spans[n][1] - tree.spans[n][0] for n, _ in whole) + len(places) == 6000
    assert len(whole) < 200
    entry, error = tree.assigned(centres)
    distance = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (entry == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    sums, counts = tree.totals(centres)
    assert (counts == np.bincount(entry, minlength=16)).all() and (sums[3] == points[entry == 3].sum(axis=0)).all()
