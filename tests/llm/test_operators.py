"""Operators against brute force, on small tables with nulls, empties, repeats, ties and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, bucket int, h long, w string, rank int, row long, fp long"
TEXTS = [
    "Hello world, this is text number one. Mail me: jane.doe@mail.example.com or +1 (555) 123-4567!",
    "", None, "   \n\t ", "one", "two words", "a b c a b c a b c",
    "Licensed under the Apache License, Version 2.0.\nReleased under the MIT license. cc by-nc cc by nc",
    "ip 10.0.0.1 and 300.1.1.1 card 4111 1111 1111 1111 and 4111 1111 1111 1112",
    "word " * 3000, "x" * 5000, "a <|endoftext|> b<|endoftext|>", "日本語 テキスト　です été d'or\r\n\r\nfin",
]


def table(spark, rows, start=0):
    data = [(start + k if k % 11 != 7 else None, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 3}", None if t is None else len(t), 1, 2, 3, "w", 4, 5, 6) for k, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = table(spark, TEXTS + TEXTS[:3])
    return rows.union(rows.limit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_tokenizer(made=[]):
    """The library's tokenizer as its file says."""
    if not made:
        import public_tokenizers
        from tokenizers import Tokenizer

        made.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return made[0]


def ids_of(text, end):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


# --- Tokens ---------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r.,'ab1éñ\x1c　!|<>s日́_#", "<|endoftext|>", "word", "'s"]), max_size=40).map("".join))
def test_pieces_encode_like_whole_texts(text):
    from orbis.llm.tokens import encoder

    enc = encoder(None)
    assert list(np.frombuffer(enc.encode(text), enc.dtype)) == plain_tokenizer().encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts():
    from orbis.llm.tokens import encoder

    enc = encoder(None)
    assert list(np.frombuffer(enc.encode("a <|endoftext|> b"), enc.dtype)) == [64, 220, 50256, 275]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=200))
def test_elias_fano_round_trip_and_select(gaps):
    from orbis.llm.tokens import ef_encode, ef_select

    ends = np.cumsum(gaps)
    low, upper, lower, samples = ef_encode(ends)
    every = np.arange(len(ends))
    assert (ef_select(every, low, upper, lower, samples) == ends).all()
    for i in ([0], [len(ends) - 1], every[::-7], every[len(ends) // 2 :]):
        assert (ef_select(np.array(i), low, upper, lower, samples) == ends[i]).all()
    # Near-minimal: about 2 + log2(universe / n) bits a value, besides the samples.
    assert 8 * (len(upper) + len(lower)) <= len(ends) * (3 + max(0, np.log2(max(1, ends[-1] / len(ends))))) + 24


def test_token_file(spark, docs, empty):
    from orbis.llm.tokens import read_token_file, write_token_file
    from orbis.session import scratch_path

    path = scratch_path(spark, "t")
    write_token_file(docs, path, block_ids=100)
    got = [tuple(r) for r in read_token_file(spark, path).orderBy("start").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert order((d, n, c) for d, _, n, c, _ in got) == order((d, len(ids_of(t, 2)), crc(ids_of(t, 2))) for d, t in rows)
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert all(len(g[4]) == 4 * g[2] for g in got)
    path = scratch_path(spark, "t")
    write_token_file(empty, path)
    assert read_token_file(spark, path).count() == 0


def test_packing(spark, docs, empty):
    from orbis.llm.packing import lengths, pack

    assert lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8] and lengths(1, 2048) == [1]
    got = [r.asDict() for r in pack(docs, most=64).collect()]
    want = Counter()
    for r in docs.collect():
        ids, at = ids_of(r["text"], 1), 0
        for n in lengths(len(ids), 64):
            want[r["doc_id"], at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids)] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["bucket"] for r in by] == sorted(r["bucket"] for r in got) and all(r["length"] == 2 ** r["bucket"] and r["offset"] == 0 for r in got)
    assert pack(empty).count() == 0


# --- PII --------------------------------------------------------------------------------------


def base_brute(t):
    from orbis.llm.pii import KINDS, luhn

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] * (13 <= len(d) <= 19 and luhn(d))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aA@.%-+ 0123456789()", max_size=60))
def test_base_spans(text):
    from orbis.llm.pii import KINDS, base_spans

    assert sorted(base_spans(text), key=lambda x: (KINDS.index(x[0]), x[1])) == base_brute(text)


def test_pii_models_on_held_out_examples():
    from orbis.llm.pii import KINDS, examples, fitted

    for kind in KINDS:
        model, least = fitted()[kind]
        x, y = examples(kind, 1500, seed=99)
        hit = model.probability(x) >= least
        assert y[hit].mean() >= 0.98 and hit[y == 1].mean() >= 0.9


def test_pii_queries(spark, docs, empty):
    from orbis.llm.pii import detect, listed, redact

    by = {r["doc_id"]: r for r in detect(docs).collect()}
    for r in docs.collect():
        base, got = base_brute(r["text"] or ""), by[r["doc_id"]]
        if r["doc_id"] is not None:
            assert [got[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
            assert set(filter(None, listed(base).split(","))) <= set(got["spans"].split(","))
    out = {r["doc_id"]: r for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns and "<EMAIL>" in out[0]["text"] and "jane" not in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"])
    assert out[2]["text"] is None and detect(empty).count() == redact(empty).count() == 0


# --- Licenses ---------------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    from orbis.llm.licenses import PHRASES, TEMPLATES, scan, summary

    long = table(spark, ["pre " + TEMPLATES["mit"][0].replace("copies", "replicas") + " post", "the gnu general public license version 2", "MIT\x00License under the mit license"], 100)
    rows = docs.union(long)
    got = summary(scan(rows)).collect()
    want = Counter()
    for r in rows.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        at = [(i, l) for p, l in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[r["doc_id"], len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({l for _, l in at}))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[100]["labels"] == "mit" and by[100]["score"] > 0.9 and by[101]["labels"] == "gpl-2" and by[4]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert summary(scan(empty)).count() == 0


# --- Mixing -----------------------------------------------------------------------------------


def test_pfair_deviation_and_wholeness(spark):
    from orbis.llm.mixing import schedule

    counts = spark.createDataFrame([("a", 700, 0.5), ("b", 333, 0.3), ("c", 164, 0.15), ("d", 60, 0.05)], "source string, n long, w double")
    rows = sorted(schedule(counts, 1).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(1257)) and Counter(r["source"] for r in rows) == {"a": 700, "b": 333, "c": 164, "d": 60}
    first, done = [r for r in rows if r["phase"] == 0], Counter()
    for k, r in enumerate(first):
        done[r["source"]] += 1
        assert all(abs(done[s] - (k + 1) * w) < 1 + 4 * (k + 1) / 1000 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)))


def test_mix(spark, docs, empty):
    from pyspark.sql.functions import lit

    from orbis.llm.mixing import mix, mixed_order

    got = mix(docs, block_rows=2).collect()
    assert Counter(r["row"]["text"] for r in got) == Counter(r["text"] for r in docs.collect())
    size, blocks = Counter((r["source"], r["block"]) for r in got), defaultdict(set)
    for r in got:
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert max(size.values()) <= 2 and all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(size)))
    assert mixed_order(docs).columns == docs.columns and mixed_order(docs).count() == docs.count()
    assert mix(docs, weights={"s0": 3, "s1": 1}, block_rows=2).count() == docs.count() and mix(empty).count() == 0
    with pytest.raises(ValueError):
        mix(docs, most_sources=2)
    # Helper columns don't clash with those of the table, and none is lost.
    odd = docs
    for c in ("n", "hash", "_hash", "slot", "_slot", "rank_", "start", "size", "block", "in_block", "phase", "blocks", "_q", "q", "stratum", "kept", "good", "own_hash", "_own_hash"):
        odd = odd.withColumn(c, lit(7))
    from orbis.llm.quality import judge
    from orbis.llm.simhash import deduplicate

    marks = docs.selectExpr("doc_id", "1 quality", "0 toxic").filter("doc_id is not null").distinct()
    assert mixed_order(odd).columns == odd.columns and Counter(map(tuple, mixed_order(odd).collect())) == Counter(map(tuple, odd.collect()))
    assert judge(odd, marks).select("row.*").columns == odd.columns and deduplicate(odd).columns == odd.columns and deduplicate(odd).count() == deduplicate(docs).count()


# --- Chat -------------------------------------------------------------------------------------


def test_rotation(spark):
    from orbis.llm.chat import rotate

    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hello"), (1, 2, "cy", None), (1, 2, "cy", None), (1, 1, "bob", "again"), (2, None, None, "x"), (None, 0, "ann", "y"), (3, 0, "ann", "z" * 9000)]
    chat = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for size in (256, 2):
        whole = defaultdict(list)
        for r in rotate(chat, part_turns=size).collect():
            whole[r["conv_id"], r["perspective"]].append(r)
        assert {k for k in whole} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann"), (3, "ann")}
        for (conv, who), parts in whole.items():
            parts.sort(key=lambda r: r["part"])
            assert [p["part_start"] for p in parts] == np.cumsum([0, *(len(p["rendered"]) for p in parts)])[:-1].tolist()
            own = sorted(p["rendered"][m["start"] : m["end"]] for p in parts for m in p["mask"])
            said = {(r[1], r[3] or "") for r in rows if r[0] == conv and (r[2] or "unknown") == who}
            assert own == sorted(t + "<|end|>" for _, t in said) and sum(p["n_own"] for p in parts) == len(said)
            assert "".join(p["rendered"] for p in parts).count("<|assistant|>") == len(said)
    assert "<|user name=bob|>\n" in whole[1, "ann"][0]["rendered"] + whole[1, "ann"][1]["rendered"]
    assert rotate(chat.limit(0)).count() == 0


# --- Toxicity ---------------------------------------------------------------------------------


def test_kernel_is_normalised_and_tolerates_gaps():
    from orbis.llm.toxicity import dense

    v = dense(["idiot", "i-d-i-o-t", "idxiot", "teapot", "ab"])
    k = v @ v.T
    assert np.allclose(np.diag(k)[:4], 1, atol=1e-5) and k[4, 4] == 0 and k[0, 1] > 0.7 and k[0, 2] > 0.5 and k[0, 3] < 0.1


def test_sentences_and_segments():
    from orbis.llm.toxicity import STRETCH, bare, sentences_of

    assert list(sentences_of("You sc um! Go.\nNow")) == [{"you", "sc", "um!", "sc um!", "you sc"}, {"go."}, {"now"}]
    assert bare("(m-o-r-o-n!)") == "moron" and bare("loooser") == "loser" and bare("well-known") == "wel-known"
    assert len(list(sentences_of("w " * (3 * STRETCH)))) == 3 and list(sentences_of("")) == []


def test_toxicity(spark, empty):
    from orbis.llm.toxicity import score, sentences_of, train

    rng = np.random.default_rng(0)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bad = ["zwagger", "quibnox", "hrumpfel"]
    rows, labels = [], []
    for k in range(400):
        ws, toxic = [word() for _ in range(40)], k % 4 == 0
        if toxic:
            b = bad[rng.integers(3)]
            ws.insert(5, b if k % 8 else b[:3] + "x" + b[3:])
        rows.append(" ".join(ws))
        labels.append((k, 1, int(toxic)))
    docs = table(spark, rows)
    docs = docs.withColumn("doc_id", docs["doc_id"]).filter("doc_id is not null")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train(docs, marked, most=200)
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d]["predicted"], t) for d, _, t in labels if d in got and got[d]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.9
    # Disguises, a blank within, and one insult at the end of a very long text.
    clean = " ".join(rows[k % 3 + 1] for k in range(1, 5000))  # none of these has an insult
    asked = ["fa zwagger fo", "fa zwa gger fo", "fa z-w-a-g-g-e-r fo", "fa z w a g g e r fo", "fa zwaagger fo", "fa bo fo", clean, clean + ". fa zwagger fo"]
    assert [r["predicted"] for r in sorted(score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect(), key=lambda r: r["doc_id"])] == [1, 1, 1, 1, 1, 0, 0, 1]
    odd = score(table(spark, TEXTS), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd) and odd[1]["score"] == odd[2]["score"] < 0.5
    assert score(empty, train(empty, marked)).count() == 0 and next(sentences_of("s c u m!")) >= {"scum"}


# --- Quality ----------------------------------------------------------------------------------


def test_quality_counts(spark, docs, empty):
    from orbis.llm.quality import judge, keep_good, with_features

    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for r in with_features(docs).collect():  # a column _q
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        g = list(zip(w, w[1:], w[2:]))
        twice = {i + j for i, x in enumerate(g) if Counter(g)[x] > 1 for j in range(3)} if len(g) < 100 else {i + j for i in range(len(g)) for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        q = r["_q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
    assert judge(docs, labels).count() == docs.count() and keep_good(docs, labels).columns == docs.columns
    assert judge(empty, labels).count() == 0 and judge(docs, labels.limit(0)).count() == docs.count()


def test_binomial_tail_and_risk(spark):
    from math import comb

    from pyspark.sql import functions as F

    from orbis.llm.quality import binomial_tail, thresholds

    rows = spark.createDataFrame([(k, n) for n in (10, 500, 3000) for k in (0, 1, 7, 10)], "k long, n long")
    for r in rows.withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)
    rng = np.random.default_rng(1)
    texts = [" ".join("w%d" % x + ("#" * 9 if k % 5 == 0 else "") for x in rng.integers(0, 10**6, 60)) for k in range(3000)]
    docs = table(spark, texts)
    marks = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(3000)], "doc_id long, quality int, toxic int")
    (found,) = thresholds(docs.withColumn("lang", F.lit("en")), marks, risk=0.03).collect()
    assert found["k"] == 0 and found["bad"] > 500 and found["cutoffs"]["symbol_share"] > 5 and found["cutoffs"]["short_words"] is None
    assert 2000 < found["n"] < 2400 and found["p"] == pytest.approx(0.97 ** found["n"], rel=1e-6)


# --- Near-duplicates --------------------------------------------------------------------------


def test_simhash(spark, docs, empty):
    from orbis.llm.simhash import deduplicate, fingerprint_of, near_duplicates

    import xxhash

    def brute(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not w:
            return 0
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert all(fingerprint_of(t or "") == brute(t) for t in TEXTS)
    rows = [(r["doc_id"], brute(r["text"])) for r in docs.collect()]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == Counter((d, f, c) for (d, f), c in zip(rows, least))
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root)) and deduplicate(empty).count() == 0


@pytest.mark.parametrize("leaf", [2048, 48, 12])
def test_vantage_trees_lose_no_link(spark, leaf):
    from orbis.llm import simhash

    rng = np.random.default_rng(3)
    centres, fps = rng.integers(0, 2**63, 40, dtype=np.uint64), []
    for k, c in enumerate(centres):
        for _ in range(150 if k == 0 else rng.integers(1, 6)):
            x = int(c)
            for b in rng.integers(0, 64, 3 if k == 0 else rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fp = np.array(sorted(set(fps)), np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = simhash.forest(len(fp), [(i, j)])
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, leaf)).collect()}
    got = [root.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    pairs: list = []
    simhash.vp_pairs(np.arange(len(fp)), np.arange(len(fp)), fp, pairs)
    assert sum(len(p[0]) for p in pairs) == len(i) - len(fp)
    # Every row is at home in one branch of each tree; all pairs meet where one of them is; branches are pruned.
    trees = rows.selectExpr("explode(array(0, 1)) tree", "1L shard", "true home", "fp")
    branches = defaultdict(set)
    for r in simhash.routed(trees, simhash.levels_for(trees, 0, 6)).collect():
        branches[r["tree"], r["shard"]].add((r["fp"], r["home"]))
    sent = [x for rs in branches.values() for x in rs]
    assert len({k for k in branches}) > 40 and sum(h for _, h in sent) == 2 * len(fp) < len(sent) < 2 * len(fp) * 64 // 4
    met = {frozenset((a, b)) for rs in branches.values() for a, h in rs if h for b, _ in rs if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(met) == (len(i) - len(fp)) // 2


# --- Neighbours -------------------------------------------------------------------------------


def test_neighbours(spark):
    from orbis.llm.graphs import build_index, search

    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (None, rows[0][1]), rows[7]]
    table_ = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    index = build_index(table_, shard=200)
    got = defaultdict(list)
    for r in search(index, table_.filter("vec_id % 50 = 0 or vec_id in (101, 904)")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = []
    for q in [*range(0, 600, 50), 101]:
        s = u @ u[q]
        best = sorted((-round(x, 12), k) for k, x in enumerate(s) if k != q)[:5]
        hits.append(len({k for _, k in best} & {k for _, k, _ in got[q]}) / 5)
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(abs(s[k] - x) < 1e-12 for _, k, x in got[q])
    assert np.mean(hits) >= 0.9 and [k for _, k, _ in got[101]] == [100, 102, 103, 104, 105]
    assert [(k, round(x, 9)) for _, k, x in got[904]] == [(905, 1.0)] and not {900, 901, 902, 903} & set(got)
    assert search(build_index(table_.limit(0)), table_.limit(0)).count() == 0


def test_hot_fingerprints_are_joined_whole(spark):
    from orbis.llm.simhash import classes, with_classes

    rows = [(k, 0, 0 if k % 3 else 1 << k % 50) for k in range(300)]
    prints = spark.createDataFrame(rows, "doc_id long, text_hash long, fp long")
    found = classes(prints).cache()
    plain = prints.join(found, "fp").select("doc_id", "component_id")
    for hot in (0, 5, 1000):
        assert Counter(with_classes(prints, found, hot).select("doc_id", "component_id").collect()) == Counter(plain.collect())
