"""Token files, the piece table and the prefix trie against brute force, on every odd case."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderflow.llm import infill, prefixtrie, registry, tokenfiles  # noqa: E402
from orderflow.session import ship_package  # noqa: E402


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    odd = ["", None, " ", "\n", "\n\n", "a\n\nb \t c", "x  y  z　　w \x85 v", "!\x1c! a\x1cb \x1d\x1f c", "don't  it's\r\n\r\nwe'll ", "<|endoftext|>",
           "a <|endoftext|>  b<|endoftext|>\n", "<P>x", "a<S>b", "<M>", "<P", "<S <M x<", "漢字\U0001F9FF é é\n漢", "trailing   ", "   leading", "᠎ x  y"]
    alphabet = list("ab'é漢 \n\t\r\x1c <>|P1.") + ["  ", "<", "\n"]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(80)]
    long_ = " ".join(rng.choice(["alpha", "beta,", "γδ", "\n", "7"]) for _ in range(120_000))
    return odd + [long_, "x" * 300_000, odd[5], odd[5]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship_package(spark)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, "no id"), (None, None), (3, "again"), (3, "again"), ((1 << 63) - 1, "last")]
    clash = {c: F.lit("clash") for c in ("h", "i", "part", "slot", "start", "base", "infill", "n", "form", "_key")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3), rows


def test_token_files(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    frame, rows = docs
    folder = tokenfiles.token_folder(spark)
    out = tokenfiles.read_token_files(tokenfiles.write_token_files(frame, folder), folder, ids=True).collect()
    encode = Tokenizer.from_file(P.path(tokenfiles.MODEL)).encode
    want = Counter()
    for d, t in rows:
        ids = encode(t or "", add_special_tokens=False).ids + [0]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids[:50]))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids[:50])) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):      # the files hold the documents in order and without a gap
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    path = folder.replace("file:", "")
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".bin")) == 2 * at
    assert all(len(np.fromfile(f"{path}/{f}", "<u8")) > 1 for f in os.listdir(path) if f.endswith(".off"))


def test_token_file_blocks_and_memory(monkeypatch, texts):
    """Small blocks and a memory that keeps nothing give the same ids."""
    import public_tokenizers as P
    with open(P.path(tokenfiles.MODEL), "rb") as f:
        model = f.read()
    monkeypatch.setattr(tokenfiles, "BLOCK", 7)
    monkeypatch.setattr(tokenfiles, "KEPT_BYTES", 0)
    e = tokenfiles.Encoder(model)
    for t in texts[:100]:
        got = np.frombuffer(b"".join(e.encode(t or "")), e.kind)
        assert got.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert len(e) < 5


def test_token_files_of_an_empty_table_and_string_ids(spark, docs):
    folder = tokenfiles.token_folder(spark)
    none = docs[0].where("false")
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(none, folder), folder).collect() == []
    named = spark.createDataFrame([("b", "x"), ("a", "yy")], "doc_id string, text string")
    out = tokenfiles.read_token_files(tokenfiles.write_token_files(named, folder), folder).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == ["a", "b"]


def plain_infill(doc_id, text, rate=100):
    text = text or ""
    units = [u + "\n" for u in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") and text else [])
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("rate", [100, 40, 0])
def test_infill(docs, rate):
    frame, rows = docs
    out = infill.fill_in_middle(frame, rate=rate).select("doc_id", "text", "infill.*").collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in out)
    assert got == Counter((d, *plain_infill(d, t, rate)) for d, t in rows)
    for r in out:
        assert sha(r.output) == r.output_sha256
        if r.form != "plain":
            assert infill.parse(r.output, r.form, infill.SENTINELS).restore(r.form).text() == r.text
    assert infill.fill_in_middle(frame, rate=rate, output=False).where("infill.output is not null").count() == 0


def test_piece_table_never_copies_text():
    text = "one\ntwo\nthree"
    t = infill.PieceTable.of(text, infill.SENTINELS)
    t.cut(8)
    t.cut(4)
    a = t.arrange("spm")
    assert a.pieces == [(2, 0, 3), (0, 8, 5), (1, 0, 3), (0, 0, 4), (3, 0, 3), (0, 4, 4)]
    assert a.restore("spm").pieces == [(0, 0, 4), (0, 4, 4), (0, 8, 5)] and a.buffers[0] is text
    with pytest.raises(ValueError):
        infill.fill_in_middle(None, sentinels=("<P>", "<P>", "M"))


def words(text):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def plain_trie(rows):
    """The contract on lists: rows of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        built[c] = (convs.get(c - c % 20, [])[:h] if c is not None else []) + own[h:]
    member = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    below = defaultdict(list)
    for node in member:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = Counter(node[:-1] for node in member if node)
    out = Counter()
    for node, cs in member.items():
        ended = sorted(c for c in cs if c is not None and len(built[c]) == len(node))
        out[(least(cs), len(node), least(member[node[:-1]]) if node else None, len(cs), children[node],
             sum(not children[x] for x in below[node]), sum((len(member[x]) - 1) * words(x[-1][1]) for x in below[node] if x),
             sha(",".join(map(str, ended))))] += 1
    return out


@pytest.mark.parametrize("block,segment,chunk", [(4, 4096, 4096), (1, 2, 3), (3, 1, 7)])
def test_prefix_trie(spark, monkeypatch, block, segment, chunk):
    ship_package(spark)
    for name, value in (("BLOCK", block), ("SEGMENT", segment), ("CHUNK", chunk)):
        monkeypatch.setattr(prefixtrie, name, value)
    rng = random.Random(block)
    rows = []
    for c in range(90):
        if c in (20, 61):                     # an absent base, and no rows
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", None, "us"]), rng.choice(["a b", "a b", "a b", "er", None, "x\ny  z"])))
    same = [(turn, "user", f"t {turn % 2}") for turn in range(23)]
    rows += [(c, *t) for c in range(100, 140) for t in same[:rng.choice([23, 23, 23, 22, 9, 4])]]
    rows += [(None, 0, "user", "a b"), (None, 1, None, "nobody"), (7, 0, "user", "a b"), (7, 0, "user", "a b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("k", "p", "pos", "a", "n", "h", "_key", "words")})
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(frame))
    got, want = Counter(tuple(r) for r in out.collect()), plain_trie(rows)
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(frame.where("false"))).collect() == []


def test_prefix_trie_without_turns(spark):
    """Conversations that lose all their turns are members of the root alone."""
    rows = [(c, 0, "user", "x") for c in range(21, 30)]
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert Counter(tuple(r) for r in out.collect()) == plain_trie(rows)


def test_queries_on_the_tables(spark, sf):
    import duckdb
    for t in ("documents", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op12_piece_table",):
        out = registry.QUERIES[name](spark, sf)
        want = duckdb.sql(registry.ORACLE[name])
        assert Counter(map(tuple, out.select(*want.columns).collect())) == Counter(want.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in registry.QUERIES["op13_block_trie"](spark, sf).collect()) == plain_trie(rows)
    assert registry.QUERIES["op11_token_files"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
