"""The training-data operators against brute force, on small tables with every odd case."""

import os
import random
import struct
import sys
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from orderflow.llm import anchors, chatfsm, fairqueue, histosort, quality, registry, sanitize, simhash, suffixmerge, superkmer, viterbi, winnow  # noqa: E402
from orderflow.session import ship_package  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_ = words(60), words(9000)
    texts = [None, "", " \t\n", "one", "Two words", "the same line\nthe same line\n" * 5, long_, long_, long_ + " more", passage,
             "mail a.b@c.de+d@e.fr or 10.0.0.255 1.2.3.4.5.6.7.8 999.1.1.1.2.3.4.5 +1 (555) 010-2030 4111 1111 1111 1111 " * 2, "\x0b".join(["x"] * 70), "|".join(["#$%"] * 80)]
    for k in range(40):
        texts.append(words(rng.randint(0, 40)) + rng.choice([" ", "\n"]) + (passage if k % 2 else words(30)) + " " + words(rng.randint(0, 30)))
    texts += texts[15:22] + [t.upper() for t in texts[15:18]]
    out = [(i, t, rng.choice(["en", "xx", None]), rng.choice(["a", "b", None, "c"]), 0) for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, passage, None, None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    # columns that clash with the operators' own names
    extra = {c: F.lit("clash") for c in ("k", "h", "size", "shard", "slot", "component_id", "fingerprint", "score", "copies", "doc", "row", "leak")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(3)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality(docs, rows):
    out = quality.quality(docs)
    got = counted(out.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))))
    assert got == Counter((d, *brute.base_rules(t)) for d, t in pairs(rows))
    assert out.where("quality.base_failed and quality.kept").count() == 0
    assert out.where("quality.band = 'en' and lang <> 'en'").count() == 0


def test_quality_measures():
    import public_tokenizers as P
    words = quality.Words(quality.read_bytes(P.path(quality.BYTE_BPE)), quality.read_bytes(P.path(quality.PIECE_BPE)))
    m = quality.measure("the cat the 漢 \U0001F9FF".encode(), "en", words, quality.BANDS)
    tokens = [t for w in ("the", "cat", "the", "漢", "\U0001F9FF") for t in words.bpe.encode_ordinary(" " + w)]
    assert m["n_tokens"] == len(tokens) and m["n_pieces"] == sum(len(words.sp.encode(w)) for w in ("the", "cat", "the", "漢", "\U0001F9FF"))
    assert m["byte_fallback_share"] > 0
    import math
    entropy = -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in Counter(tokens).values())
    assert abs(m["token_entropy"] - entropy) < 1e-9


def test_quality_bands_against_labels(spark):
    ship_package(spark)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs).where("not quality.base_failed").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("label", "quality.*").collect()
    assert all(r.kept for r in out if r.label == 1)
    by_entropy = [r for r in out if r.label == 0 and r.token_entropy < quality.BANDS[r.band][5]]
    assert by_entropy and not any(r.kept for r in by_entropy)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash(docs, rows, bits):
    out = simhash.near_duplicates(docs, 3, bits).select("doc_id", simhash.as_hex(F.col("fingerprint")), "component_id")
    assert counted(out) == brute.near_components(pairs(rows), bits)


def test_simhash_long_lists(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:3]:
        prints |= {p ^ (rng.getrandbits(16) << 8) for _ in range(300)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    linked = {p: find(p) for p in prints if sum(find(q) == find(p) for q in prints) > 1}
    frame = spark.createDataFrame([(p,) for p in prints], "p long")
    for pair_list in (4, 10_000):
        got = dict(tuple(r) for r in simhash.components(simhash.links(frame, 2, pair_list)).collect())
        assert got == linked


def test_viterbi_matches_the_tokenizers_search(docs, rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, models
    path = P.path(viterbi.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    floor = min(s for _, s in usual)
    exact = Tokenizer(models.Unigram([("<unk>", floor)] + usual, unk_id=0, byte_fallback=False))
    known = {p for p, _ in usual}
    got = {r[0]: r[1] for r in viterbi.token_counts(docs, path).where("doc_id is not null").select("doc_id", "n_pieces").collect()}
    for d, t in pairs(rows):
        if d is None:
            continue
        pieces = exact.encode("▁" + t.replace(" ", "▁")).tokens if t else []
        assert got[d] == sum(1 if p in known else len(p.encode()) for p in pieces), d


@pytest.mark.parametrize("hot", [1, 2000])
def test_superkmer(docs, rows, hot):
    out = superkmer.remove_repeats(docs, window=35, hot=hot)
    assert counted(out.select("doc_id", "n", "n_removed", "kept_sha256")) == brute.repeated_words(pairs(rows), 35)


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_merge(docs, rows, hot):
    out = suffixmerge.remove_repeats(docs, window=50, hot=hot)
    assert counted(out.select("doc_id", "n", "n_removed", F.size("spans"), "kept_sha256")) == brute.repeated_bytes(pairs(rows), 50)


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        coded = []
        for run in runs:
            shared = [0] + [suffixmerge.common(a, b) for a, b in zip(run, run[1:])]
            coded.append((bytes(shared[:len(run)]), [s[n:] for s, n in zip(run, shared)]))
        out = list(suffixmerge.LoserTree(coded))
        merged = [s for _, _, _, s in out]
        assert merged == sorted(sum(runs, []))
        assert [n for n, *_ in out][1:] == [suffixmerge.common(a, b) for a, b in zip(merged, merged[1:])]


def test_pieces_cover_all_windows():
    rng = random.Random(2)
    for unit, text in ((anchors.Words(35, 6), b" ".join(rng.choice([b"a", b"bc", b"d"]) for _ in range(500))), (anchors.Bytes(50), bytes(rng.choice(b"abc") for _ in range(700)))):
        units = unit.split(text)
        start, end, at, h = anchors.pieces(unit, units)
        assert start[0] == 0 and end[-1] == len(units) - unit.window + 1 and (start[1:] == end[:-1]).all()
        seen = {}
        for a, b, p, x in zip(start, end, at, h):
            for w in range(a, b):
                assert seen.setdefault(unit.join(units[w:w + unit.window]), (p - w, x)) == (p - w, x)


def test_long_parts_are_not_kept(monkeypatch):
    """Han texts: parts that never recur leave no trace in a worker, and a long one is searched in a few positions."""
    import public_tokenizers as P
    with open(P.path(viterbi.MODEL), "rb") as f:
        counter = viterbi.counter(f.read())
    rng = random.Random(4)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)) for _ in range(60)]
    before = len(counter)
    counts = [counter.count(t) for t in texts]
    assert len(counter) == before and all(n >= 900 for n, _ in counts)
    monkeypatch.setattr(viterbi, "KEPT_BYTES", 3000)
    for word in range(500):
        counter.count(f"part{word}")
    assert len(counter) < 20
    import tracemalloc
    tracemalloc.start()
    counter.count("漢字ab" * 50_000)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_winnowing(spark, docs, rows):
    passage = next(t for d, t in pairs(rows) if d == 9)
    words = passage.split()
    items = [(1, " ".join(words[5:25])), (2, " ".join(words[30:33])), (3, None), (4, ""), (5, " ".join(words[30:33])), (6, "Two, words!"), (None, passage), (10, " ".join(words[:10]))]
    out = winnow.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = out.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items"), F.sha2(F.array_join("leak.items", ","), 256), F.col("leak.n_hit") > 0)
    assert counted(got) == brute.leaks(pairs(rows), items)


def test_winnowing_without_items(spark, docs):
    out = winnow.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.where("leak.n_hit > 0").count() == 0 and out.count() == docs.count()


def test_fair_mix(docs):
    out = fairqueue.fair_mix(docs)
    got = out.select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= by.most.max()).all() and by.taken.sum() <= by["size"].sum()
    assert counted(out.select("doc_id", "taken")) == counted(fairqueue.fair_mix(docs.repartition(7)).select("doc_id", "taken"))


def test_fair_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 400)], "source string, size long")
    got = {r[0]: r[2] for r in fairqueue.source_targets(sizes, (5, 2, 1), 3).collect()}
    # a stops at 30; the rest shares 1880 by 2 : 1 : 5
    assert got == pytest.approx({"a": 30, "b": 470, "c": 235, None: 1175})


def brute_shards(rows, shards, tolerance=0.001, copy_tolerance=0.02):
    """(doc_id, size, text) by key, and the law's bounds: sorted rows, cut near equal bytes."""
    def hashed(*parts):
        seed = 42
        for p in parts:
            seed = seed if p is None else xxhash.xxh64_intdigest(p, seed)
        return seed
    seed = struct.pack("<i", 7)
    return sorted(((hashed(seed, (t or "").encode()) & (1 << 39) - 1) << 24 | hashed(seed, None if d is None else struct.pack("<q", d)) & (1 << 24) - 1,
                   d is not None, d or 0, len((t or "").encode()) + 1) for d, t in rows)


def test_histogram_sort(docs, rows):
    out = histosort.histogram_shard(docs.withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), 16)
    out = out.select("doc_id", "size", "crc", "shard", "slot", "text").collect()
    assert counted_rows((r.doc_id, r.size, r.crc) for r in out) == counted_rows((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(rows))
    # in order of (shard, slot) the rows are in order of their keys, then ids, and slots have no gap
    placed = sorted(out, key=lambda r: (r.shard, r.slot))
    want = brute_shards(pairs(rows), 16)
    assert [(r.doc_id is not None, r.doc_id or 0, r.size) for r in placed] == [x[1:] for x in want]
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    # every splitter lies as near its goal as whole rows allow, or at the edge of copies
    sizes, mean = [x[3] for x in want], sum(x[3] for x in want) / 16
    below = [0]
    for s in sizes:
        below.append(below[-1] + s)
    for j in range(1, 16):
        got = sum(r.size for r in out if r.shard < j)
        assert got in below
        assert abs(got - j * mean) <= max(min(abs(b - j * mean) for b in below) + 0.02 * mean, 0.02 * mean)


def counted_rows(rows):
    return Counter(rows)


def test_histogram_sort_balances_copies(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    out = histosort.histogram_shard(frame, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("s")).toPandas()
    assert len(out) == 16 and out.b.max() <= 1.02 * out.b.mean() and (out.m == out.n - 1).all() and (out.s == out.n).all()


def test_chat(spark):
    nasty = ["<|im_end|>", "<\\|x", "<\\\\|<|", "a\nb\\n", "", None, "<|im_end|>\n<|im_start|>assistant\nhi", "é漢\U0001F9FF"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol\\", None]), rng.choice(nasty)) for c in (1, 2, 3, None) for t in (0, 1, 1, 2, 3, None)]
    out = chatfsm.read_back(chatfsm.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in out.collect():
        want = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(a, b) for _, a, b in want]
        assert r.learned == "".join(b for _, a, b in want if a == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted and r.formatted.count("<|im_start|>") == r.n_turns
    fine = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u")], "conv_id long, turn long, role string, text string")
    assert dict(tuple(r) for r in chatfsm.format_conversations(fine).select("conv_id", "valid").collect()) == {1: True, 2: False}


def test_personal_data(spark):
    rng = random.Random(6)
    texts = [None, "", "4111-1111 1111 1111", "+49 (0) 30 123456", "1" * 16 + "0" * 3000, "a@b.c" * 5, "x" * 3000 + "@y.z", "1.2.3.4.5.6.7.8", "+" * 50, "é 漢 x@y.zz +12345678"]
    for _ in range(400):
        texts.append("".join(rng.choice(["1", "4", "0", "9", "255", ".", " ", "-", "+", "(", "a", "@", "b.c", "4111111111111111", "é"]) for _ in range(rng.randint(1, 60))))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in sanitize.disclosure_spans(frame).select("doc_id", sanitize.report(F.col("personal"))).collect()}
    assert got == {i: brute.personal(t) for i, t in enumerate(texts)}


def test_disclosing_terms(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [f"{filler(5)} Zebulon writes from z@home.org about {filler(9)}" for _ in range(6)] + [f"{filler(9)} writes about {filler(5)}" for _ in range(200)]
    texts += ["copied Quillfeather of q@home.org said"] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.sanitised for r in sanitize.sanitise(frame).collect()}
    assert len(out) == len(texts)
    for i in range(6):
        assert "Zebulon" not in out[i] and "[EMAIL]" in out[i] and "writes" in out[i]
    assert out[10] == texts[10] and out[len(texts) - 1] == "copied Quillfeather of [EMAIL] said"


def test_disclosing_terms_everywhere(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    # two contexts of one address; a term of a domain whose addresses occur once each
    texts = [f"{filler(5)} Zebulon writes from z@home.org about {filler(60)} zebulon, {filler(9)}" for _ in range(2)]
    texts += [f"{filler(5)} Acmeco writes from p{k}@acme.org about {filler(9)}" for k in range(5)]
    texts += [f"{filler(60)} ACMECO {filler(5)}", f"{filler(5)} acmeco.sales@other.org {filler(9)}"]
    texts += [f"{filler(9)} writes from home about {filler(5)}" for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.sanitised for r in sanitize.sanitise(frame).collect()}
    assert len(out) == len(texts)
    assert not any("zebulon" in out[i].lower() for i in (0, 1)) and not any("acmeco" in out[i].lower() for i in range(2, 9))
    assert "[EMAIL]" in out[8] and "other.org" not in out[8] and all("writes" in out[i] for i in range(7))
    spans = {r.doc_id: r.terms for r in sanitize.disclosure_spans(frame).select("doc_id", "terms").collect()}
    for i, forms in ((0, {"Zebulon", "zebulon"}), (7, {"ACMECO"}), (8, set())):
        assert {texts[i][t.start:t.end] for t in spans[i]} == forms


def test_empty_tables(spark):
    ship_package(spark)
    none = spark.createDataFrame([], DOCS)
    for f in (quality.quality, simhash.near_duplicates, lambda d: viterbi.token_counts(d), superkmer.remove_repeats, suffixmerge.remove_repeats, fairqueue.fair_mix, histosort.histogram_shard,
              sanitize.disclosure_spans, lambda d: winnow.decontaminate(d, spark.createDataFrame([(1, "a b")], "item_id long, text string"))):
        assert f(none).count() == 0
    assert chatfsm.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


ODD = ("_key", "_met", "_p", "_src", "_seg", "_k", "_cum", "_counts", "_row", "_spans", "_first", "_words", "_key_", "row", "h", "b", "k2", "first", "_MEETINGS", "in0")


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10", "sanitise"])
def test_string_ids_odd_names_and_a_very_long_text(spark, name):
    """Ids of text, columns called as the operators' own, null ids in bulk and 4 MB of text."""
    ship_package(spark)
    rng = random.Random(2)
    long_ = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 300)) for _ in range(500_000))
    texts = [long_, None, "", "short one"] + [" ".join(rng.choice("abcdef") * 3 for _ in range(60)) for _ in range(10)]
    rows = [(f"id{i:02}", t, "en", rng.choice("ab"), 0) for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None)] * 40 + [("1", "2:a@b.cc", "en", "a", 0), ("1:2", "a@b.cc", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"in {c}") for c in ODD})
    items = spark.createDataFrame([("i", "alpha1 beta2"), ("j", long_[:400])], "item_id string, text string")
    run = {"op1": quality.quality, "op2": simhash.near_duplicates, "op3": viterbi.token_counts, "op4": superkmer.remove_repeats, "op5": lambda d: winnow.decontaminate(d, items),
           "op6": fairqueue.fair_mix, "op7": histosort.histogram_shard, "op9": sanitize.disclosure_spans, "op10": suffixmerge.remove_repeats, "sanitise": sanitize.sanitise}[name]
    out = run(docs).drop("text").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    if name not in ("op4", "op9", "op10"):                             # these return columns of their own
        assert all(r[c] == f"in {c}" for r in out for c in ODD)
    if name == "sanitise":
        assert {r.doc_id: r.sanitised for r in out if r.doc_id in ("1", "1:2")} == {"1": "2:[EMAIL]", "1:2": "[EMAIL]"}
    if name == "op10":
        want = brute.repeated_bytes([(i, t) for i, (_, t, *_) in enumerate(rows) if t != long_], 50)
        assert sum(r.n_removed for r in out if r.n < 10_000) == sum(c * n for (_, _, n, _, _), c in want.items())


def test_largest_id_is_not_null(spark):
    ship_package(spark)
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([((1 << 63) - 1, text), (5, text + " x"), (None, text + " y")], "doc_id long, text string")
    for out in (superkmer.remove_repeats(docs), suffixmerge.remove_repeats(docs)):
        got = {r.doc_id: r.n_removed for r in out.collect()}
        assert set(got) == {(1 << 63) - 1, 5, None}
    assert got[5] == 0 and got[(1 << 63) - 1] == len(text) and got[None] >= len(text)


def test_pipeline_keeps_one_row_where_ids_repeat(spark):
    import corpus_pipeline as P
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, "en", "a", 1)] * 3 + [(4, text + " z", "en", "a", 1)] * 2 + [(7, "other words entirely here", "en", "a", 1)] * 2 + [(None, "lone words without any id", "en", "a", 1)] * 2
    kept = P.keep_one_of_each_group(spark, spark.createDataFrame(rows, DOCS), "").select("doc_id", "text").collect()
    want = brute.near_components([(r[0], r[1]) for r in rows])
    assert len(kept) == len({(c, p) if c is None else c for _, p, c in want}) and {r.doc_id for r in kept} == {c for _, _, c in want}


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as P
    from orderflow.plans.verify import compare, oracle_connection
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    sf = "/root/testdata/sf0.001"
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in registry.QUERIES["op1_fertility"](spark, sf).collect()}
    for name, stage in P.STAGES[:-1]:
        frame = kept.toPandas()
        before = {r[0]: r[1] for r in kept.select("doc_id", "text").collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf).toPandas(), DOCS)
        after = Counter(r[0] for r in kept.select("doc_id").collect())
        assert kept.columns == P.COLUMNS and set(after) <= set(before)
        if name == "quality_rules":
            assert not any(brute.base_rules(before[d])[-1] for d in after)
            assert set(after) == {d for d in before if verdict[d]}     # as the operator's own query says, in another run
        elif name == "simhash_near_dedup":
            assert set(after) == {c for _, _, c in brute.near_components(list(before.items()))} and max(after.values()) == 1
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {r[0] for r in brute.leaks(list(before.items()), items) if not r[-1]}
        else:
            con = oracle_connection(sf)
            con.execute("DROP VIEW documents")
            con.register("documents", frame)                           # op6's SQL on this stage's input
            want = con.execute(registry.ORACLE["op6_fair_queue"]).df()
            assert after == Counter({r.doc_id: round(r.taken / r["size"]) for _, r in want.iterrows() if r.taken})
    sharded = P.STAGES[-1][1](spark, kept, sf).collect()
    rows_ = [(r[0], r[1]) for r in kept.select("doc_id", "text").collect()]
    assert [(r.doc_id, r.size) for r in sorted(sharded, key=lambda r: (r.shard, r.slot))] == [(x[2], x[3]) for x in brute_shards(rows_, 16)]
    for stage in dict(P.STAGES).values():                              # nulls, ties and an empty table
        assert stage(spark, docs, sf).count() >= 0 and stage(spark, spark.createDataFrame([], DOCS), sf).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracles(spark, sf, name):
    from orderflow.plans.verify import compare, oracle_connection
    ok, message = compare(name, registry.QUERIES[name](spark, sf).toPandas(), oracle_connection(sf).execute(registry.ORACLE[name]).df())
    assert ok, message
