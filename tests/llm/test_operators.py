"""The operators against brute force on small tables, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import byte_bpe, iso_media, line_dedup, mixing, ngram_join, quality_rules, queries, suffix_tree, token_counts, toxicity, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "one"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "x" * 5000), (8, "naïve ½ ² \U0001f600 'll　\x1c z")]


def table(spark, rows=ODD):
    return spark.createDataFrame([(d, t, "n", 0, 7) for d, t in rows], "doc_id long, text string, lang string, n bigint, key int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    def plain(df):
        value = lambda v: None if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else int(v)
        return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)

    assert plain(got) == plain(want)


def test_quality_rules(spark):
    good = "\n".join(" ".join(f"w{k}{j}" for j in range(8)) + "." for k in range(10))
    rows = [*ODD, (20, good), (21, good + "\nhome | news | sport | about | help\nAll rights reserved."), (22, "menu | a | b | c | d\n" * 30)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert got[20]["kept"] and got[21]["kept"] and got[21]["clean_text"] == good and not got[22]["kept"] and got[1]["n_words"] == 0
    assert got[22]["n_dup_lines"] == 29 and got[22]["n_repeat_words"] == got[22]["n_words"]
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = [*ODD, (30, "the quick brown fox jumps\nshort one"), (31, "The quick brown fox jumps high\nshort one"), (32, "the quick red fox jumps\nnew line here now"), (33, None)]
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got[30] == (rows[8][1], 0) and got[31] == ("", 2) and got[32] == ("new line here now", 1) and got[33] == (None, 0) and got[6] == ("", 1)
    exact = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.dedup_lines(table(spark, rows), exact=True).collect()}
    assert (exact[31], exact[32], exact[6]) == (1, 0, 1)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_of_null_and_repeated_ids(spark):
    texts = ["one two three\nfour five six", "four five six\nseven eight nine", "ten eleven twelve\nthirteen fourteen fifteen"]
    df = table(spark, [(None, t) for t in texts] + [(7, t.replace("e", "i")) for t in texts] + [(8, "same text here"), (8, "same text here")])
    df = df.withColumns({"n_lines_left": F.lit("mine"), "d": F.lit(1), "__gone": F.lit(2), "k": F.lit(3), "a.b": F.lit(4)})
    got = line_dedup.dedup_lines(df)
    assert sorted(got.columns) == sorted(df.columns + ["n_lines_removed"]) and got.count() == 8
    rows = got.collect()
    for d, t in ((None, texts), (7, [x.replace("e", "i") for x in texts])):
        left = [line for r in rows if r["doc_id"] == d for line in r["text"].split("\n")]
        assert sorted(left) == sorted({line for x in t for line in x.split("\n")})  # each line once, whichever row is first
    assert [(r["text"], r["n_lines_removed"]) for r in rows if r["doc_id"] == 8] == [("same text here", 0)] * 2


def lowered(text):
    return (text or "").encode().lower().decode()


def components(rows):
    """Brute force over all pairs of rows: id, set size and component of each row, sorted."""
    sets = []
    for _, t in rows:
        w = WORDS.findall(lowered(t))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, len(sets[k]), least.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows):
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("n", "x", "r", "comp", "component_id", "n_shingles")})
    return sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=repr)


def test_ngram_join(spark):
    rng, rows = random.Random(3), list(ODD)
    pool = [f"w{k}" for k in range(200)]
    base = [rng.choice(pool) for _ in range(80)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(80)] = rng.choice(pool)
        rows.append((100 + k, " ".join(w)))
    for k in range(80):
        b = [rng.choice(pool[:5]) for _ in range(rng.randrange(1, 24))]
        rows += [(300 + k, " ".join(b)), (500 + k, " ".join(b[:-1]))]
    assert joined(spark, rows) == components(rows)
    assert ngram_join.ngram_components(table(spark, [])).count() == 0


def test_ngram_join_of_null_and_repeated_ids(spark):
    text = lambda k, n=12: " ".join(f"t{k}x{j}" for j in range(n))
    rows = [(None, text(1)), (None, text(1)), (None, text(2)), (1, text(3)), (1, text(4)), (1, text(3)), (2, text(4)), (2, text(1)), (9, text(5)), (None, None), (None, ""), (3, "")]
    got = joined(spark, rows)
    assert len(got) == len(rows) and got == components(rows)


def test_ngram_join_of_a_large_group(spark):
    """Copies of one text with few or many words changed, so that lists hold sets that link and sets that don't, and a long
    passage that other texts share."""
    rng = random.Random(5)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(150):
        w = list(base)
        for j in rng.sample(range(120), rng.randrange(5)):
            w[j] = rng.choice([f"n{k}", f"m{k % 7}"])
        rows.append((k, " ".join(w)))
    rows += [(500 + k, " ".join([*base[:60], *(f"o{k}y{j}" for j in range(60 - k))])) for k in range(40)]
    assert joined(spark, rows) == components(rows)


def test_ngram_join_makes_a_pair_once(spark):
    """The join of open lists makes a pair about once, not for each common element, and only pairs that link or nearly do."""
    rng, sets = random.Random(7), []
    base = [rng.getrandbits(64) for _ in range(140)]
    for k in range(200):
        sets.append(np.sort(np.array([*rng.sample(base, 140 - k % 60), *(rng.getrandbits(64) for _ in range(k % 60))], "u8")))
    df = spark.createDataFrame([(k, len(x), bytearray(x.tobytes())) for k, x in enumerate(sets)], "r long, n long, x binary")
    lists, order = ngram_join._lists(df, 1, 85)
    labels = spark.createDataFrame([(0, 0)], "r long, comp long")  # no links are known yet
    found = ngram_join.outsiders(lists, labels, 85, ngram_join.sketches(df, *order))
    pairs = Counter(map(tuple, found.collect()))
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in itertools.combinations(range(200), 2)}
    links = {p for p, k in both.items() if 100 * k >= 85 * (280 - k)}
    assert links and links <= pairs.keys() and len(pairs) < 1.5 * len(links) and max(pairs.values()) == 1
    made, todo = 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        while (name := node.nodeName()) == "AdaptiveSparkPlan" or "QueryStage" in name:
            node = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan()
        made += node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert len(pairs) <= made < 1.2 * len(pairs)


@pytest.mark.parametrize("held", [byte_bpe.WORDS_HELD, 30])
def test_byte_bpe(spark, held):
    rows = [*ODD, (None, "null id"), (6, "same id"), *((r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    encode = byte_bpe.encoder(byte_bpe.read_ranks()).encode_ordinary
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("ids", "words", "block", "at", "id")})
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.decode(byte_bpe.encode(df, held=held)).collect())
    want = Counter()
    for d, t in rows:
        ids = encode(t or "")
        want[d, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()] += 1
    assert got == want
    lengths = Counter(tuple(r) for r in byte_bpe.token_lengths(df, held=held).collect())
    assert lengths == Counter((d, len(encode(t or ""))) for d, t in rows)
    assert byte_bpe.decode(byte_bpe.encode(table(spark, []))).count() == 0


def test_byte_bpe_decodes_where_it_encodes(spark):
    """The result is put together and decoded by one Python worker a task, in batches of some documents."""
    docs = table(spark, [*ODD, *((k, "same text") for k in range(100, 2000))])
    rows = lambda df: Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    found = byte_bpe.encoded_and_decoded(docs)
    assert rows(found) == rows(byte_bpe.decode(byte_bpe.encode(docs)))
    plan = queries.QUERIES["op4_byte_bpe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_decoding_unknown_ids_fails(spark):
    ids = spark.createDataFrame([(1, bytearray(struct.pack("<I", 50_256)))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(ids).collect()


def test_registered_bpe_queries(spark):
    encode = byte_bpe.encoder(byte_bpe.read_ranks()).encode_ordinary
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op4_byte_bpe"](spark, SF).collect()}
    sizes = Counter()
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = encode(t or "")
        sizes[len(ids)] += 1
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[d] == (len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest())
    rows = {r["n_tokens"]: r for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == sizes
    for n, r in rows.items():
        assert r["truncated_total"] == sum(c * min(n, m) for m, c in sizes.items()) and r["docs_at_least"] == sum(c for m, c in sizes.items() if m >= n)


def test_token_counts(spark):
    n = [0, 0, 3, 3, 3, 5, 2000, 1023, 1024, 3_000_000, 1 << 31, (1 << 31) - 1]
    rows = {r["n_tokens"]: r for r in token_counts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")).collect()}
    for x in set(n):
        r = rows[x]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x))
        assert r["truncated_total"] == sum(min(x, y) for y in n) and r["quantile"] == pytest.approx(sum(y <= x for y in n) / len(n))
    sums = token_counts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    cut = token_counts.at_limits(sums, spark.createDataFrame([(4,), (9999,)], "context int")).collect()
    assert {r["context"]: (r["docs_longer"], r["truncated_total"]) for r in cut} == {4: (7, sum(min(x, 4) for x in n)), 9999: (3, sum(min(x, 9999) for x in n))}
    assert token_counts.histogram(sums.limit(0)).count() == 0


def test_iso_media(spark):
    rows = ODD
    packed = table(spark, rows).select("doc_id", iso_media.pack("text").alias("media"))
    got = {r["doc_id"]: r for r in iso_media.media_columns(packed).withColumn("r", iso_media.unpack("media")).collect()}
    for d, t in rows:
        p = iso_media.padded((t or "").encode())
        assert bytes(got[d]["r"]["payload"]) == p and got[d]["r"]["tail_crc32"] == zlib.crc32(p[-64:])
        track = got[d]["tracks"][0]
        assert track["codec"] == "raw" and track["n_samples"] == len(p) // 64 and len(track["keyframes"]) == math.ceil(len(p) / 1024)
        k = track["keyframes"][0]
        assert bytes(got[d]["media"])[k["offset"] : k["offset"] + k["length"]] == p[:64]
    bad = spark.createDataFrame([(bytearray(b"no media at all"),), (None,)], "media binary")
    assert [(r["error"] is not None) for r in iso_media.media_columns(bad).collect()] == [True, False]


def test_hostile_media(spark):
    """Deep boxes, sample tables that claim more than the file has, keyframes and chunks that don't exist: an error each, no crash."""
    media = iso_media.pack_bytes(iso_media.padded(b"x" * 200))
    deep = b""
    for _ in range(3000):
        deep = iso_media._box(b"mdia", deep)
    at = lambda kind: media.index(kind) + 4
    put = lambda place, data: media[:place] + data + media[place + len(data) :]
    bad = {
        "deep": iso_media._box(b"moov", iso_media._box(b"trak", deep)), "many": put(at(b"stsz") + 8, b"\xff" * 4), "zero": put(at(b"stss") + 8, bytes(4)),
        "beyond": put(at(b"stss") + 8, b"\0\0\0\x63"), "chunk": put(at(b"stsc") + 8, bytes(4)), "rows": put(at(b"stss") + 4, b"\xff" * 4), "each": put(at(b"stsc") + 12, b"\xff" * 4),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in [*bad.items(), ("good", media)]], "k string, media binary")
    got = {r["k"]: (r["error"] is None, len(r["tracks"])) for r in iso_media.media_columns(rows).collect()}
    assert got == {k: (False, 0) for k in bad if k != "each"} | {"good": (True, 1), "each": (True, 1)}


def test_hostile_lengths_in_payloads(spark, tmp_path):
    head = lambda n: f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: {n}\r\n\r\nhello"
    rows = [(k, "u", head(n)) for k, n in enumerate(("9" * 20, "9" * 5000, "9" * 16, "0" * 40 + "5", "-1", "²", "1e3"))]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = {r["id"]: bytes(r["content"]).decode().split("\r\n\r\n", 1)[1] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {f"<{warc.ID}{k}>": html for k, _, html in rows}


def test_warc_with_magic_inside_payloads(spark, tmp_path):
    fake = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(k, f"http://x/{k} y", ("y" * (k % 7) + fake) * (k % 9)) for k in range(40)] + [(100, None, None), (101, "", "")] + [(200 + k, "u", "same" * 40) for k in range(3)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}/w")
        got = {r["id"]: bytes(r["content"]).split(b"\r\n\r\n", 1)[1] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows)
    seen: set = set()
    for k, _, html in rows:
        again = html and len(html) >= 100 and html in seen
        assert got[f"<urn:x-page:{k}>"] == (b"" if again else (html or "").encode())
        seen.add(html)


def test_toxicity(spark):
    rng = random.Random(1)
    clean = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for d in range(600):
        w = [rng.choice(clean) for _ in range(40)]
        if bad := d % 4 == 0:
            w[rng.randrange(40)] = "vile"
            w[rng.randrange(40)] = "nasty"
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(bad)))
    docs += [(9001, None), (9002, "")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, docs), marks).collect()}
    held = [(got[d]["predicted"], y) for d, _, y in labels if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and got[9001]["score"] == got[9002]["score"]
    assert toxicity.toxicity(table(spark, docs[:3]), marks.limit(0)).count() == 3


def test_toxicity_keeps_the_prior_of_a_large_table(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for d in range(20_000):
        bad = rng.random() < 0.1
        w = [f"word{chr(97 + rng.randrange(26))}" for _ in range(6)]
        if rng.random() < (0.8 if bad else 0.1):  # the word tells the classes apart in part only
            w[3] = "vile"
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table(spark, docs), marks).collect()}
    fold = [(got[d], y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 5 == 4]
    assert sum(p for p, _ in fold) / len(fold) == pytest.approx(sum(y for _, y in fold) / len(fold), abs=0.01)


class BruteTree:
    """The suffix tree by counting every context of every training text."""

    def __init__(self, texts):
        self.n = Counter()
        for t in texts:
            run = self.run(t)
            for k in range(suffix_tree.DEPTH, len(run)):
                for m in range(suffix_tree.DEPTH + 1):
                    self.n[run[k - m : k], run[k]] += 1
        self.total = Counter()
        for (c, _), n in self.n.items():
            self.total[c] += n
        gain = Counter()
        for (c, x), n in self.n.items():
            if c:
                gain[c] += n * math.log(n / self.total[c] / (self.n[c[1:], x] / self.total[c[1:]]))
        self.states = {c for c in self.total if not c or self.total[c] >= suffix_tree.MIN_COUNT and gain[c] >= suffix_tree.MIN_GAIN}

    @staticmethod
    def run(text):
        words = (text or "").encode().lower().split()
        return b"\t" * suffix_tree.DEPTH + b" ".join(words) + b"\n"

    def p(self, c, x):
        if not c:
            return (self.n[c, x] + suffix_tree.SMOOTHING / 256) / (self.total[c] + suffix_tree.SMOOTHING)
        low = self.p(c[1:], x)
        return (self.n[c, x] + suffix_tree.SMOOTHING * low) / (self.total[c] + suffix_tree.SMOOTHING) if c in self.states else low

    def score(self, text):
        run, d = self.run(text), suffix_tree.DEPTH
        return sum(math.log10(self.p(run[k - d : k], run[k])) for k in range(d, len(run)))


@pytest.mark.parametrize("block", [suffix_tree.BLOCK_BYTES, 2000])
def test_suffix_tree(spark, block):
    rows = [*ODD, (None, "null id"), (6, "same id"), *((r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("score", "train", "run", "block", "n_tokens")})
    got = sorted(map(tuple, suffix_tree.lm_scores(df, F.col("doc_id") % 3 != 0, block_bytes=block).collect()), key=repr)
    assert len(got) == len(rows)
    split = lambda t: [*WORDS.findall(lowered(t)), ""]
    taught = [t for d, t in rows if d is not None and d % 3]
    c, model = Counter(w for t in taught for w in split(t)), BruteTree(taught)
    n = sum(c.values())
    want = []
    for d, t in rows:
        w = split(t)
        base = sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)
        want.append((d, len(w), sum(c[x] > 0 for x in w), n, base, model.score(t)))
    for g, w in zip(got, sorted(want, key=repr)):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    assert suffix_tree.lm_scores(table(spark, []), F.lit(True)).count() == 0
    none = suffix_tree.lm_scores(table(spark, ODD), F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)} and all(r["score"] < 0 for r in none)


def test_suffix_tree_reads_the_order_of_words(spark):
    docs = table(spark, [(d, "ab cd ef gh ij kl mn op" if d < 90 else None) for d in range(100)] + [(200, "ab cd ef gh ij kl mn op"), (201, "op mn kl ij gh ef cd ab"), (202, "")])
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in suffix_tree.lm_scores(docs, F.col("doc_id") < 100).collect()}
    assert got[200][1] == pytest.approx(got[201][1]) and got[200][0] > got[201][0] + 5
    assert got[202][0] == pytest.approx(-1, abs=0.2)  # a tenth of the training texts is empty


def test_mixing(spark):
    cells = [("a", 60, 0.9, 0.05, 0.05), ("b", 30, 0.1, 0.8, 0.1), ("c", 10, 0.2, 0.1, 0.7)]
    df = spark.createDataFrame(cells, "cell string, words long, p_good double, p_low double, p_toxic double")
    goal = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    rates = {r["cell"]: r["rate"] for r in mixing.fit_rates(df, goal).collect()}
    for k, d in enumerate(("good", "low", "toxic")):
        assert sum(rates[c] * w * p[k] for c, w, *p in cells) / 100 == pytest.approx(goal[d], abs=0.01)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(table(spark), none).count() == len(ODD)


def test_mixing_reaches_the_share_of_a_rare_domain(spark):
    columns, domains = "cell string, words long, p_good double, p_low double, p_toxic double", ("good", "low", "toxic")
    goal = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    for rare in (3, 1):
        cells = [("a", 60, 0.9, 0.05, 0.05), ("b", 40 - rare, 0.1, 0.85, 0.05), ("c", rare, 0.05, 0.05, 0.9), ("d", 0, 1.0, 0.0, 0.0)]
        rates = {r["cell"]: r["rate"] for r in mixing.fit_rates(spark.createDataFrame(cells, columns), goal).collect()}
        assert min(rates.values()) >= 0
        for k, d in enumerate(domains):
            assert sum(rates[c] * w * p[k] for c, w, *p in cells) / 100 == pytest.approx(goal[d], abs=mixing.TOLERANCE)
    cells = [("a", 50, 0.5, 0.1, 0.4), ("b", 50, 0.1, 0.5, 0.4)]
    with pytest.warns(UserWarning, match="no rates reach"):  # all words are toxic in part
        mixing.fit_rates(spark.createDataFrame(cells, columns), {"good": 1.0, "low": 0.0, "toxic": 0.0})


def test_mixing_rates_by_brute_force(spark):
    """Posteriors by plain counting, and rates that a check over all documents holds to the targets."""
    rng = random.Random(4)
    own = {"good": [f"fine{k}" for k in range(12)], "low": [f"poor{k}" for k in range(12)], "toxic": [f"vile{k}" for k in range(12)]}
    docs, marks = [], []
    for d in range(240):
        kind = ("good", "good", "good", "low", "toxic")[d % 5]
        docs.append((d, " ".join(rng.choice(own[kind] + own["good"][:4]) for _ in range(rng.randrange(5, 40)))))
        if d % 2:
            marks.append((d, int(kind != "low"), int(kind == "toxic")))
    docs += [(None, "fine1 vile2"), (7, docs[7][1]), (900, None), (901, "")]
    df = table(spark, docs).withColumns({c: F.lit(1) for c in ("n_tokens", "rate", "words", "f0", "__words", "domain")})
    goal = {"good": 0.6, "low": 0.25, "toxic": 0.15}
    got = mixing.mixing_rates(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), goal).collect()
    assert len(got) == len(docs) and Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    total = sum(r["n_tokens"] for r in got)
    for k in goal:
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{k}"] for r in got) / total == pytest.approx(goal[k], abs=mixing.TOLERANCE)
    assert min(r["rate"] for r in got) >= 0 and len({(r["n_tokens"], r["rate"]) for r in got if r["doc_id"] == 7}) == 1
    # The classifier: Bernoulli over telling words, and steps.
    words = {d: WORDS.findall(lowered(t)) for d, t in docs if d is not None}
    taught = {d: "toxic" if x else "good" if q else "low" for d, q, x in marks}
    sizes = Counter(taught.get(d) for d, _ in docs if d in taught)
    has = lambda w, c: sum(w in words[d] for d, _ in docs if taught.get(d) == c)
    vocabulary = set()
    for c in goal:
        value = {}
        for w in {w for d in taught for w in words[d]}:
            inside, outside = (has(w, c) + 0.5) / (sizes[c] + 1), (sum(has(w, o) for o in goal if o != c) + 0.5) / (sum(sizes.values()) - sizes[c] + 1)
            if has(w, c) >= mixing.MIN_DOCS and inside * math.log(inside / outside) > 0:
                value[w] = inside * math.log(inside / outside)
        vocabulary |= set(sorted(value, key=lambda w: (-value[w], w))[: mixing.VOCABULARY])
    steps = lambda w: (int(math.log2(len(w) + 1)), len(set(w)) * 20 // max(len(w), 1), 0)
    values = [{steps(words[d])[k] for d in taught} for k in range(3)]
    for r in got:
        if r["doc_id"] is not None:
            w, logs = words[r["doc_id"]], {}
            for c in goal:
                p = {x: (has(x, c) + 4 * (sum(has(x, o) for o in goal) + 0.5) / (sum(sizes.values()) + 1)) / (sizes[c] + 4) for x in vocabulary}
                logs[c] = math.log((sizes[c] + 1) / (sum(sizes.values()) + 3)) + sum(math.log(p[x]) for x in vocabulary if x in w)
                for k in range(3):
                    same = sum(steps(words[d])[k] == steps(w)[k] for d, _ in docs if taught.get(d) == c)
                    share = (sum(steps(words[d])[k] == steps(w)[k] for d in taught for _ in range(sum(x == d for x, _ in docs))) + 1) / (sum(sizes.values()) + len(values[k]) + 1)
                    logs[c] += math.log((same + 4 * share) / (sizes[c] + 4))
            whole = sum(math.exp(x) for x in logs.values())
            assert [r[f"p_{c}"] for c in goal] == pytest.approx([math.exp(logs[c]) / whole for c in goal])
    with pytest.raises(ValueError, match="targets must name"):
        mixing.mixing_rates(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {"good": 1.0})
    assert mixing.mixing_rates(table(spark, []), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_values_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(k % 2, " ".join(rng.choice(["a", "b", "c1", "d-e", "x" if k % 2 else "y"]) for _ in range(rng.randrange(1, 12)))) for k in range(40)]
    model = toxicity.KneserNey(toxicity.ngram_counts(spark.createDataFrame(rows, "toxic int, text string")))
    n = [Counter(), Counter()]
    for c, t in rows:
        w = toxicity.tokens(t)
        n[c].update(zip(["", *w], w))
    D = toxicity.DISCOUNT
    every = {w for c in n for _, w in c}
    cont = [Counter(w for _, w in c) for c in n]
    shared = {w: min(cont[0][w] / len(n[0]), cont[1][w] / len(n[1])) * len(n[0]) + 1 for w in every}
    whole = sum(shared.values()) + 1
    p = lambda c, w: (max(cont[c][w] - D, 0) + D * len(cont[c]) * shared[w] / whole) / len(n[c])
    text = "a x y b. c1 d-e x x never b y a x"
    found = toxicity.tokens(text)
    want = [0.0 if w not in every else math.log(p(1, w) / p(0, w)) for w in found]
    assert model.differences(found).tolist() == pytest.approx(want)
    assert model.value("a x never") == pytest.approx((want[0] + want[1]) / 3)
    assert model.value(text) == pytest.approx(max(sum(want[k : k + toxicity.WINDOW]) for k in range(len(want) - toxicity.WINDOW + 1)) / toxicity.WINDOW)
    assert toxicity.tokens("Unbelievable, (x1)! ...") == ["unbel", "+ievab", "+le", "x1", "..."]


def test_toxicity_of_odd_rows(spark):
    docs = [(d, f"plain words here {d % 3}" + (" vile nasty" if d % 4 == 0 else "")) for d in range(400)] + [(None, "vile nasty"), (4, "plain words here 1"), (900, None), (901, "")]
    marks = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(400)] * 2, "doc_id long, quality int, toxic int")
    df = table(spark, docs).withColumns({c: F.lit(1) for c in ("toxic", "fold", "value", "score", "predicted")})
    got = toxicity.toxicity(df, marks).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[900] == by[901] and len(by[None]) == 1 and by[8] == by[20] and toxicity.toxicity(table(spark, []), marks).count() == 0


def test_quality_rules_with_clashing_columns(spark):
    df = table(spark, [*ODD, (None, "null id"), (6, "again")]).withColumns({c: F.lit("mine") for c in ("kept", "n_words", "clean_text", "__q_row", "a.b")})
    got = quality_rules.quality_rules(df)
    assert len(got.columns) == len(set(got.columns)) and set(df.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and {r["a.b"] for r in rows} == {r["__q_row"] for r in rows} == {"mine"} and {r["kept"] for r in rows} == {False}
    assert [r["n_words"] for r in rows if r["doc_id"] is None] == [2]


def test_iso_media_with_clashing_columns(spark):
    df = table(spark, [*ODD, (None, "x"), (6, ODD[5][1])]).withColumns({"error": F.lit(1), "tracks": F.lit(2), "a.b": F.lit(3)})
    got = iso_media.media_columns(df.withColumn("media", iso_media.pack("text")))
    assert sorted(got.columns) == sorted([*df.columns, "media"])
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and all(r["error"] is None and r["a.b"] == 3 for r in rows) and len({bytes(r["media"]) for r in rows if r["doc_id"] == 6}) == 1
    assert iso_media.media_columns(spark.createDataFrame([], "media binary")).count() == 0


def test_registered_media_query(spark):
    want = {}
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        p = iso_media.padded((t or "").encode())
        want[d] = (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    got = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in queries.QUERIES["op5_iso_media"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_warc_with_odd_rows(spark, tmp_path, broadcast, monkeypatch):
    """Null and repeated ids, clashing columns, an empty table; also where joins shuffle."""
    if broadcast == "-1":
        monkeypatch.setattr(warc, "bounded", lambda df: df)
    long_ = "p" * 150
    rows = [(None, "u", long_), (3, "u", long_), (2, "u", long_), (2, "u", "q" * 120), (None, "u", "r" * 200), (None, "u", "r" * 200), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload_bytes", "record_type", "refers_to", "payload_digest")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.classify(df).collect())
        warc.write_archives(df, f"file://{tmp_path}/w")
        got = Counter((r["id"], r["type"], len(r["content"].split(b"\r\n\r\n", 1)[1])) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted([(0, "revisit", 2), (3, "revisit", 2), (2, "response", None), (2, "response", None), (0, "response", None), (0, "response", None), (4, "response", None)], key=lambda x: (x[0], x[1]))
    assert sum(got.values()) == len(rows) and got["<urn:x-page:2>", "response", 150] == 1 and got["<urn:x-page:none>", "response", 200] == 2
    warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_mixing_meets_targets_by_great_multiples(spark):
    """Documents whose posteriors differ by hundredths: rates meet the targets all the same, unless the caller bounds multiples."""
    rows = [(k, 100, 0.34 + 0.01 * (k % 3 == 0), 0.33 + 0.01 * (k % 3 == 1), 0.33 + 0.01 * (k % 3 == 2)) for k in range(90)]
    cells = spark.createDataFrame([(k, w, *(x / (a + b + c) for x in (a, b, c))) for k, w, a, b, c in rows], "doc_id long, words long, p_good double, p_low double, p_toxic double")
    targets = {"good": 0.345, "low": 0.3275, "toxic": 0.3275}
    got = mixing.fit_rates(cells, targets).toPandas()
    assert (got["rate"] >= 0).all() and all(abs((got["rate"] * got[f"p_{d}"] * got["words"]).sum() / 9000 - targets[d]) < 1e-4 for d in targets)
    assert (got["rate"] - 1).abs().max() > 0.3
    with pytest.warns(UserWarning, match="no rates reach"):
        mixing.fit_rates(cells, targets, most=1.0).collect()
