"""The ten operators against brute force, on whole small tables and on odd rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bitplanes, components, decontamination, fingerprints, jaccard, line_dedup, packing, quality, sharding, splitters, token_counts, tokens, url_filters
from plumbline.llm.common import new_folder

from ..conftest import SF
from ..oracle import assert_same
from .data import empty, odd

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# ---- 1


def shards_hold(rows, n):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(0 <= s < n for s in by)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    total, top = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    for s in range(n):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / n) <= top


def test_sharding(spark, docs, texts):
    rows = sharding.shard_documents(docs, 24).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards_hold(rows, 24)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    rows = sharding.shard_documents(odd(spark), 3).collect()
    assert len(rows) == 12
    shards_hold(rows, 3)
    assert sharding.shard_documents(empty(spark), 3).count() == 0


def test_sharding_cuts_one_large_group(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(df, 5, ranges_per_shard=4, sample_rows=200).collect()
    shards_hold(rows, 5)


def test_overfull_ranges_are_cut_again(spark):
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.lit(1).cast("long").alias("w"))
    got = splitters.sampled_ranges(rows, ("k", "t"), "w", 40, sample_rows=60)
    assert sum(got.weights) == 2000 and max(got.weights) <= 150


# ---- 2, 6


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path, texts):
    tok, e, c = Tokenizer.from_file(path), tokens.Encoder(path, limit=50), tokens.Encoder(path, counts=True)
    r = random.Random(3)
    odd_ = ["", " ", "  a  b\n\n c \n", "x'll don't it's 'S  ", "<|endoftext|> hi", "İstanbul ß é ẞ \x1c \x85 a\xa0b", "日本 123 456", "a" * 300 + " " + "b!" * 50, "Ünï 1.5e3 – “q” €5", "\n \n", "well. no, yes! a.b", "q? ;: ."]
    odd_ += ["".join(r.choice(["a", "B", " ", " ", "\n", "'s", "'", "1", "é", "!", "\t", "ñ", "…", "€", "Жы", ".", ", "]) for _ in range(40)) for _ in range(300)]
    for t in [*odd_, *list(texts.values())[:100]]:
        want = tok.encode(t, add_special_tokens=False).ids
        got = e.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want and c.encode(t) == len(want)


def test_long_texts_are_cut_into_segments():
    t = "some words and more " * 200_000
    assert "".join(tokens.segments(t)) == t and len(list(tokens.segments(t))) > 2


def test_packed_table_round_trip():
    table = {" a": 1, "ñ": 2, "🙂": 3}
    assert tokens.unpack_table(tokens.pack_table(table)) == table and tokens.unpack_table(tokens.pack_table({})) == {}


@pytest.mark.parametrize("by", ["bit", "byte"])
def test_planes_round_trip(by):
    r = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = r.integers(0, 50_000, n).astype("<u4")
        width = int(ids.max()).bit_length() if by == "bit" else -(-int(ids.max()).bit_length() // 8)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, width, by), n, by) == ids).all()


def check_files(rows, expected, encode):
    at = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), expected, strict=True):
        want = struct.pack(f"<{len(ids := encode(text) + [0])}I", *ids)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(want))
        at += len(ids)


@pytest.mark.parametrize("by", ["bit", "byte"])
def test_token_files(spark, docs, texts, by):
    tok = Tokenizer.from_file(BYTE)
    encode = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    m = bitplanes.write_token_files(docs, BYTE, new_folder(spark, "t"), block=1000, by=by)
    check_files(bitplanes.read_token_files(m).collect(), sorted(texts.items()), encode)
    rows = bitplanes.read_token_files(bitplanes.write_token_files(odd(spark), BYTE, new_folder(spark, "t"), block=64, by=by)).collect()
    want = [(r.doc_id, r.text) for r in odd(spark).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    check_files(rows, want, encode)
    assert bitplanes.read_token_files(bitplanes.write_token_files(empty(spark), BYTE, new_folder(spark, "t"))).count() == 0


def test_token_counts(spark, docs, texts):
    tok = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(docs, BYTE).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    got = token_counts.count_tokens(odd(spark), BYTE).collect()
    assert len(got) == 12 and {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (3, 4)} == {(0, 0)}
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0
    assert token_counts.count_tokens(odd(spark), public_tokenizers.path("piece_bpe_32k.model")).where("n_tokens > 0").count() == 10


# ---- 3


def test_url_filters(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = [*url_filters.LISTED, *url_filters.PATTERNS]
    for n in (256, 0):
        assert_same(url_filters.filter_urls(pages, rules, map_rules=n), url_filters.OP3_SQL, SF)


def test_url_filters_on_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://net/", "http://net", "http://anet/", "x://y.org/fr/?q", "x://org/fr", "http://example.net/en", "a://b://c", "http://casino-win.x.com", "http://x.net/en/casino-win", "http://example.net/EN/"]
    rules = [*url_filters.LISTED, *url_filters.PATTERNS]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def brute(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(h + p) for h, p in (("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len, default=None)

    for n in (256, 0):
        got = url_filters.filter_urls(df, rules, map_rules=n).collect()
        assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {k: brute(u) for k, u in enumerate(urls)}
        assert {r.page_id for r in got if r.pattern} == {12}
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0
    assert url_filters.rules_of(["block net/", "", "# nothing", "allow Example.net/en/  # why", "words casino win"])[1:] == [url_filters.host_rule("example.net", "/en/", "allow"), url_filters.word_rule("casino", "win")]
    index = url_filters.rarest_token_index(df.withColumn("_tokens", url_filters.url_tokens(url_filters.url_host(F.col("url")), url_filters.url_path(F.col("url")))), [url_filters.host_rule("example.net", "/en/", "allow")])
    assert list(index) == ["en"] or list(index) == ["example"]


def test_ten_thousand_url_rules(spark, tmp_path):
    """A long list, read from a file, against every rule run on every URL."""
    r = random.Random(6)
    tlds, names, dirs = ["com", "net", "org", "de"], [f"n{k}" for k in range(1500)], ["en", "de", "a-b", "x", "news2"]
    lines = {f"{r.choice(['', r.choice(names) + '.'])}{r.choice(names)}.{r.choice(tlds)}/{r.choice(['', r.choice(dirs) + '/', r.choice(dirs)])}" for _ in range(13_000)}
    lines = sorted(lines)[:11_000] + ["net/", "org/en/"]
    verdicts = {k: r.choice(["block", "allow"]) for k in lines}
    words = [(a, b) for a in names[:40] for b in names[40:60]]
    (tmp_path / "rules.txt").write_text("\n".join([*(f"{v} {k}" for k, v in verdicts.items()), *(f"words {a} {b}" for a, b in words)]))
    rules = url_filters.load_rules(spark, str(tmp_path / "rules.txt"))
    assert len(rules) == len(lines) + len(words) >= 11_000
    hosts = [r.choice(lines).split("/")[0] for _ in range(300)] + [f"{a}-{b}.{r.choice(tlds)}" for a, b in r.sample(words, 30)] + [f"q{k}.test" for k in range(30)] + ["n1.net"] * 150
    urls = [f"http://{r.choice(['', 'www.'])}{h.upper() if r.random() < 0.1 else h}/{r.choice(dirs)}{r.choice(['', '/', '/p?q', '#f'])}" for h in hosts]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(u):
        host, path = re.fullmatch(r"http://([^/?#]*)([^?#]*).*", u).groups()
        host, best = host.lower(), None
        for k, v in verdicts.items():
            h, _, p = k.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(k), k) > (len(best[0]), best[0])):
                best = (k, v)
        if best:
            return best
        return None, "block" if any(re.search(rf"(^|[.-]){a}[.-]{b}([.-]|$)", host) for a, b in words) else "allow"

    want = {k: brute(u) for k, u in enumerate(urls)}
    got = url_filters.filter_urls(df, rules).collect()
    assert {x.page_id: (x.rule, x.verdict) for x in got} == want and len(got) == len(urls)


# ---- 4


def test_packing_is_sound_and_search_only_gains():
    for seed, sigma in ((1, 0.3), (2, 1.2)):
        r = random.Random(seed)
        counts = collections.Counter(min(100, max(1, int(r.lognormvariate(3.4, sigma)))) for _ in range(3000))
        start = packing.best_fit_decreasing(counts, 100)
        end = packing.local_search(start, 100)
        for bins in (start, end):
            held = collections.Counter()
            for items, n in bins.items():
                assert 0 < sum(items) <= 100
                for x in items:
                    held[x] += n
            assert held == counts
        assert sum(end.values()) <= sum(start.values()) and packing.squared_fill(end) >= packing.squared_fill(start)


def test_local_search_empties_a_bin():
    bins = {(50, 30): 1, (45, 35): 1, (20, 20): 1}  # 200 in all, two bins of 100
    assert sum(packing.local_search(bins, 100).values()) == 2


def test_local_search_exchanges_all_alike_bins_at_once():
    few, many = ({(60, 30): n, (50, 40): n, (10,): 2 * n} for n in (10, 100_000))
    assert sum(packing.local_search(few, 100).values()) == 20 and sum(packing.local_search(many, 100).values()) == 200_000


def test_packing_of_one_row_repeated(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    seqs = collections.defaultdict(list)
    for x in packing.pack_documents(df, WORD, capacity=64).collect():
        seqs[x.sequence_id].append((x.offset, x.length))
    assert sum(map(len, seqs.values())) == 2000
    for parts in seqs.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_a_text_of_some_megabytes(spark):
    """One very long row goes whole through every operator that reads texts."""
    r = random.Random(1)
    text = " ".join(r.choice(["alpha", "Beta,", "gamma.", "\n", "9", "delta"]) + str(r.randrange(3000)) for _ in range(400_000))
    rows = [(1, text, "a"), (2, "short one of five words", "b"), (3, text, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tok = Tokenizer.from_file(BYTE)
    n = len(tok.encode(text, add_special_tokens=False).ids)
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df, BYTE).collect()}[1] == n
    files = bitplanes.read_token_files(bitplanes.write_token_files(df, BYTE, new_folder(spark, "t"))).collect()
    assert {x.doc_id: x.n_tokens for x in files}[3] == n + 1
    assert sum(x.length for x in packing.pack_documents(df, BYTE, 4096).where("doc_id = 1").collect()) == n + 1
    assert as_rows(jaccard.jaccard_components(df)) == brute_components([(d, t) for d, t, _ in rows])
    bench = spark.createDataFrame([(1, " ".join(text.split()[-60:-20])), (2, "words that stand nowhere in there at all")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.find_leaks(df, bench).collect()} == {(1, 1), (3, 1)}
    assert {x.doc_id for x in fingerprints.fingerprint_edits(df).collect() if x.fingerprint == brute_fingerprint(text)} == {1, 3}
    assert quality.score_quality(df, np.zeros((1 << 20) + 1, np.float32)).count() == 3 and line_dedup.line_dedup_stage(df).count() == 3
    shards_hold(sharding.shard_documents(df, 2).collect(), 2)


def test_packing(spark, docs, texts):
    tok = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, capacity=512).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert sorted(by) == sorted(texts)
    for d, parts in by.items():
        ids = tok.encode(texts[d], add_special_tokens=False).ids + [1]
        at = 0
        for k, p in enumerate(sorted(parts, key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length])))
            at += p.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    assert len(seqs) <= 1.01 * sum(r.length for r in rows) / 512 + 1
    whole = packing.packed_sequences(docs.limit(20), WORD, 512).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 2048 for r in whole)
    assert packing.pack_documents(odd(spark), WORD).count() >= 12 and packing.pack_documents(empty(spark), WORD).count() == 0


# ---- 5


def test_line_dedup(spark):
    from plumbline.llm.queries import ORACLE_SQL, QUERIES

    assert_same(QUERIES["op5_line_dedup"](spark, SF), ORACLE_SQL["op5_line_dedup"], SF)


def test_line_dedup_near_the_threshold(spark):
    rows = [(k * 10 + s, f"line of {k} sites\nown {k} {s}", f"s{s}") for k in range(1, 8) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (0, 10):
        got = line_dedup.remove_boilerplate(df, min_sites=5, broadcast_lines=n).collect()
        gone = {r.doc_id for r in got if r.n_removed}
        assert gone == {k * 10 + s for k in range(5, 8) for s in range(1, k)}
        assert {r.text for r in got if r.doc_id in gone} == {f"own {d // 10} {d % 10}" for d in gone}
    many = spark.createDataFrame([(k, "shared", f"s{k}") for k in range(40)], "doc_id long, text string, source string")
    assert line_dedup.line_dedup_stage(many).count() == 1


def test_line_dedup_counts_exactly_near_the_threshold(spark):
    """Spreads from far below to far above the threshold, by brute force; sketches alone err there."""
    r = random.Random(12)
    sites = [f"site{k}" for k in range(400)]
    held = {f"shared line {k}": r.sample(sites, max(1, int(100 * r.uniform(0.6, 1.4)))) for k in range(60)}
    rows = [(k, "\n".join([f"own {s}", *(x for x, where in held.items() if s in where)]), s) for k, s in enumerate(sites)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.spread_lines(line_dedup.document_lines(df, "doc_id", "text", "source"), 100)
    keys = {(x.k.h, x.k.g): x.line for x in spark.createDataFrame([(x,) for x in held], "line string").select("line", line_dedup.line_key(F.col("line")).alias("k")).collect()}
    assert {keys[x.h, x.g]: x.keeper for x in got.collect()} == {x: min(sites.index(s) for s in where) for x, where in held.items() if len(where) >= 100}


def test_line_dedup_on_odd_rows(spark):
    got = line_dedup.remove_boilerplate(odd(spark), min_sites=2)
    rows = {(r.doc_id, r.text) for r in got.collect()}
    assert got.count() == 12 and (2, "") in rows and (3, None) in rows and set(got.columns) == {*odd(spark).columns, "n_lines", "n_removed"}
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0 and line_dedup.line_dedup_stage(odd(spark)).columns == odd(spark).columns


# ---- 7


def test_decontamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {(d, i) for d, t in texts.items() for i, x in items.items() if x.casefold() in t.casefold()}
    blocks = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench, block_bytes=1000).collect()}
    assert blocks == found


def test_decontamination_of_edited_passages(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    r, rows = random.Random(5), []
    vocab = sorted({w for t in list(texts.values())[:100] for w in t.split()})
    for i in bench.collect():
        ws = [r.choice(vocab) if r.random() < 0.15 else w for w in i.text.split()]
        parts = r.choice(list(texts.values())).split(" ")[:400]
        k = r.randrange(len(parts) + 1)
        rows.append((i.item_id, " ".join(parts[:k] + ws + parts[k:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = {x.doc_id for x in decontamination.find_leaks(df, bench).collect() if x.doc_id == x.item_id}
    assert len(hit) >= 0.9 * len(rows)


def test_decontamination_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word"), (2, None), (3, ""), (3, "a text without an id, of some words"), (None, "same")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(odd(spark), bench).collect()}
    assert (None, 3) in got and (9, None) in got and not any(d in (3, 4, 5) for d, _ in got)
    assert decontamination.find_leaks(empty(spark), bench).count() == 0 and decontamination.find_leaks(odd(spark), bench.limit(0)).count() == 0


def test_decontamination_behind_a_run_of_one_word(spark):
    names = [f"w{k}" for k in range(40)]
    passage = " ".join(names)
    text = " ".join(["w39"] * 60 + [f"z{k}" for k in range(65)] + names)
    others = [(k, " ".join(names[:20])) for k in range(2, 12)]
    df = spark.createDataFrame([(1, text), *others], "doc_id long, text string")
    got = decontamination.find_leaks(df, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [(1, 7, 1.0)] and got[0].cosine <= 1 and got[0].word_start > 60


def test_decontamination_of_short_and_long_passages_in_many_documents(spark, monkeypatch):
    r = random.Random(11)
    vocab = [f"v{k}" for k in range(2000)]
    plain = [f"p{k}" for k in range(5000)]
    texts = [" ".join(r.choice(vocab) for _ in range(n)) for n in (6, 9, 15, 17, 30, 40, 40, 40, 60, 90, 300, 1500)]
    rows = [(k, " ".join([*r.choices(plain, k=203), t, *r.choices(plain, k=203)])) for k, t in enumerate(texts)]
    count = decontamination.document_counts

    def many(docs, text_col, known):  # the passages' words stand in a third of 30 million documents
        return {w: 10_000_000 * k for w, k in count(docs, text_col, known)[0].items()}, 30_000_000

    monkeypatch.setattr(decontamination, "document_counts", many)
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(k, k) for k in range(len(texts))}


def test_decontamination_behind_a_decoy_of_the_same_words(spark):
    r = random.Random(4)
    passages = [[f"p{k}x{r.randrange(300)}" for _ in range(r.randrange(20, 60))] for k in range(40)]
    rows = []
    for k, p in enumerate(passages):
        decoy = r.sample(p, len(p))
        rows.append((k, " ".join([*decoy, *[f"z{r.randrange(4000)}" for _ in range(300)], *p, "end"])))
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, text string")
    got = {x.doc_id: (x.item_id, x.lcs) for x in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {k: (k, 1.0) for k in range(40)}


def brute_leaks(texts, items, min_lcs=decontamination.MIN_LCS):
    """Each passage against all texts by the words alone: verbatim, or nowhere near its words in any stretch."""
    found, far = set(), set()
    for d, t in texts.items():
        ws = decontamination.words(t or "")
        joined = f" {' '.join(ws)} "
        have = set(ws)
        for i, x in items.items():
            p = decontamination.words(x)
            if f" {' '.join(p)} " in joined:
                found.add((d, i))
            elif sum(w in have for w in p) < min_lcs * len(p):
                far.add((d, i))
    return found, far


def test_decontamination_against_forty_thousand_words(spark):
    """A benchmark of 40,000 different words: all verbatim passages are found, none whose words aren't there."""
    r = random.Random(8)
    vocab = [f"{a}{b}{k}" for k in range(40) for a in "abcdefghij" for b in ("ra", "mo", "ti", "qu", "ze") for _ in range(1)] + [f"word{k}" for k in range(38_000)]
    r.shuffle(vocab)
    items, at = {}, 0
    while at < len(vocab):
        n = r.choice((12, 30, 45, 70, 300))
        items[len(items)] = " ".join(vocab[at : at + n])
        at += n
    wide = [f"c{k}" for k in range(3000)]
    texts = {}
    for d in range(400):
        parts = r.choices(wide, k=r.randrange(50, 400)) + r.choices(vocab, k=100)
        r.shuffle(parts)
        if d % 2:
            parts[len(parts) // 3 : len(parts) // 3] = items[r.randrange(len(items))].split()
        texts[d] = " ".join(parts)
    texts[400] = " ".join([*r.choices(wide, k=600_000), *items[5].split(), *r.choices(wide, k=3)])  # some megabytes
    found, far = brute_leaks(texts, items)
    assert len(found) >= 200
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(df, bench).collect()}
    assert found <= got and not got & far


def test_decontamination_leaves_words_outside_the_passages_apart(spark):
    """Words that no passage has match nothing, whatever the size of the benchmark."""
    passage = [f"q{k}" for k in range(30)]
    doc = passage[::3] + [f"other{k}" for k in range(20)]
    bench = [(1, " ".join(passage))] + [(k, f"filler{k} text{k} more{k}") for k in range(2, 60)]
    got = decontamination.find_leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert got == []


def test_decontamination_stage_with_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a text without an id, of some words")], "item_id long, text string")
    kept = decontamination.decontamination_stage(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == 11


def test_lcs():
    r = random.Random(2)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(r.randrange(0, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs_length(np.array(a, int), np.array(b, int)) == t[-1][-1]


# ---- 8


def brute_components(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * (o := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - o):
                root[find(b)] = find(a)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((rows[k][0] is None, rows[k][0] or 0, len(sets[k]), lowest[find(k)] if lowest[find(k)] is not None else -1) for k in sets)


def as_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def near_copies(seed, n, words=40, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(edits)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        rows.append(" ".join(t[: len(t) - r.randrange(4)]))
    return rows


def test_jaccard_join(spark, docs, texts):
    assert as_rows(jaccard.jaccard_components(docs)) == brute_components(sorted(texts.items()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_of_near_copies_around_the_threshold(spark, seed):
    rows = list(enumerate(near_copies(seed, 60) + near_copies(seed + 10, 30, 12, 2) + near_copies(seed + 20, 30, 90, 6)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(jaccard.jaccard_components(df)) == brute_components(rows)


def test_jaccard_join_where_ids_are_joined_and_buckets_follow_the_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_SETS", -1)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 20)
    rows = list(enumerate(near_copies(4, 40) + near_copies(14, 20, 12, 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(jaccard.jaccard_components(df)) == brute_components(rows)


def versions_of_one_text(seed, short, long):
    """Copies with scattered edits of a text, most with a passage that the others (the most central ones) have lost."""
    r = random.Random(seed)
    base, lost = ([f"w{r.randrange(10**6)}" for _ in range(n)] for n in (86, 64))
    rows = []
    for k in range(short + long):
        t = base + lost * (k >= short)
        for _ in range(6 if k >= short else k > 0):
            t[r.randrange(len(t))] = f"e{r.randrange(10**9)}"
        rows.append(" ".join(t))
    return rows


def test_jaccard_join_counts_few_pairs_of_a_group_of_near_copies_that_are_not_linked(spark, monkeypatch):
    rows = list(enumerate(versions_of_one_text(5, 40, 200)))
    counted, count = [], jaccard.count_overlaps

    def counting(pairs, *rest):
        found = count(pairs, *rest)
        counted.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "count_overlaps", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(jaccard.jaccard_components(df)) == brute_components(rows)
    assert sum(counted) < 10 * len(rows)  # of 28,680 pairs


def test_jaccard_join_on_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert as_rows(jaccard.jaccard_components(odd(spark))) == brute_components(rows)
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    assert jaccard.near_duplicate_stage(odd(spark)).count() == 11


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_components_of_a_long_chain_with_shuffled_ids(spark):
    ids = random.Random(3).sample(range(10**9), 3000)
    df = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == dict.fromkeys(ids, min(ids))


# ---- 9


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    w = quality.train_quality(big, labels)
    got = quality.score_quality(big, w).join(labels, "doc_id").select(quality.held_out(F.col("doc_id")).alias("h"), "quality", "quality_score").collect()
    for r in got:
        assert 0 <= r.quality_score <= 1
    held = [r for r in got if r.h]
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train_quality(big, flipped) == w).all()  # held-out labels are never seen


def brute_features(text):
    """Five sets of n-grams by dictionaries: {(set, gram): value}, each set of unit length."""
    out = {}
    ws = [m[0] for c in (text or "").split() for m in re.finditer(quality.WORD, c)]
    low = [w.lower() for w in ws]
    shapes = [(quality.shape(w), k > 0 and low[k] == low[k - 1]) for k, w in enumerate(ws)]
    for k, (units, n) in enumerate(((low, 1), (low, 2), (low, 3), (shapes, 2), (shapes, 3))):
        grams = collections.Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))
        size = sum(grams.values()) ** 0.5
        out |= {(k, g): c**0.5 / size for g, c in grams.items()}
    return out


def test_quality_features_are_the_n_grams():
    """As many features with the same values as by hand; equal texts have equal places."""
    made = quality.Features(bits=31)
    texts = ["A word, a word and A WORD said said said!! 12 x_y", "", None, "one", "two words", "a b c a b c a b c", "Ünï — “q” …", "x" * 3000 + " " + "long text " * 2000]
    got = collections.defaultdict(list)
    for row, place, value in made.of(texts):
        for r, _, v in zip(row, place, value, strict=True):
            got[r].append(round(v, 9))
    for r, t in enumerate(texts):
        assert sorted(got[r]) == sorted(round(v, 9) for v in brute_features(t).values())


def test_quality_learns_as_by_hand(spark):
    """FTRL over the n-grams themselves, with a dictionary of weights, gives the scores of the hashed model."""
    r = random.Random(7)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    texts = {k: " ".join(r.choices(good if k % 3 else bad, k=r.randrange(3, 30)) + r.choices(good + bad, k=3)) for k in range(120)}
    labels = {k: int(k % 3 > 0) for k in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = spark.createDataFrame([*labels.items(), (1, 1), (5, None)], "doc_id long, quality int")  # labels said twice or not at all
    w = quality.train_quality(df, lab, bits=23)
    got = {x.doc_id: x.quality_score for x in quality.score_quality(df, w).collect()}
    z, n, order = collections.defaultdict(float), collections.defaultdict(float), sorted((k for k in texts if zlib.crc32(str(k).encode()) % 3 != 1), key=lambda k: (zlib.crc32(str(k).encode()), k))

    def weight(f):
        return 0.0 if abs(z[f]) <= quality.L1 else -(z[f] - (quality.L1 if z[f] > 0 else -quality.L1)) / ((quality.BETA + n[f] ** 0.5) / quality.ALPHA + quality.L2)

    def score(x):
        return 1 / (1 + np.exp(-sum(weight(f) * v for f, v in x.items())))

    feats = {k: brute_features(t) | {"bias": 1.0} for k, t in texts.items()}
    count = [sum(labels[k] == c for k in order) for c in (0, 1)]
    for _ in range(quality.EPOCHS):
        for k in order:
            p, by = score(feats[k]), min(4.0, len(order) / (2 * count[labels[k]]))
            old = {f: weight(f) for f in feats[k]}
            for f, v in feats[k].items():
                g = (p - labels[k]) * v * by
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / quality.ALPHA * old[f]
                n[f] += g * g
    for k in texts:
        assert abs(got[k] - score(feats[k])) < 2e-3  # places that two n-grams share, and 32-bit weights


def test_quality_on_odd_rows(spark):
    w = quality.train_quality(odd(spark), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert not w.any()
    got = quality.score_quality(odd(spark), w)
    assert got.count() == 12 and got.where("quality_score = 0.5").count() == 12 and quality.score_quality(empty(spark), w).count() == 0
    kept = quality.quality_stage(odd(spark), spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int"))
    assert kept.columns == odd(spark).columns


# ---- 10


def brute_fingerprint(text):
    lanes = [0] * fingerprints.LANES
    for u in re.split(r"[\n\r]+\s*|(?<=[.!?])\s+", text or ""):
        if u:
            for k in range(fingerprints.WORDS):
                seed = xxhash.xxh64_intdigest(struct.pack("<i", k), 42)
                h = xxhash.xxh64_intdigest(u.encode(), seed)
                for j in range(4):
                    lanes[8 * k + 2 * j] += (h >> 8 * j & 255) - 128
                    lanes[8 * k + 2 * j + 1] += (h >> 8 * (j + 4) & 255) - 128
    return "".join(f"{x % 65536:04x}" for x in lanes)


def test_fingerprints(spark, docs, texts):
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(t), brute_fingerprint(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    """A third of the rows without an id and a third with one id are cut into ranges; every row has its own next one."""
    texts = [f"text {k}. of some length\nand lines {k % 7}" * (1 + k % 5) for k in range(300)]
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprints.fingerprint_edits(df, ranges=24).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    want = collections.Counter()
    for k, (d, t) in enumerate(order):
        cut, nxt = len(t) // 3, order[(k + 1) % len(order)][1]
        want[d, hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def lanes_of(fp):
    return np.array([(int(fp[4 * k : 4 * k + 4], 16) + 32768) % 65536 - 32768 for k in range(fingerprints.LANES)], float)


def test_likeness_is_the_cosine(spark, docs, texts):
    ids = sorted(texts, reverse=True)
    after = {d: ids[(k + 1) % len(ids)] for k, d in enumerate(ids)}
    cosine = lambda a, b: 1.0 if (a == b).all() else max(0.0, min(1.0, float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))))) if a.any() and b.any() else 0.0
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    for d, r in rows.items():
        own = lanes_of(r.fingerprint)
        assert abs(r.near_edited - cosine(own, lanes_of(r.edited_fingerprint))) < 1e-9 and abs(r.near_next - cosine(own, lanes_of(rows[after[d]].fingerprint))) < 1e-9


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(1, "a b.\nc d.\ne f."), (2, "e f.\na b.\nc d."), (3, "a b.\nc d."), (4, "e f."), (5, "")], "doc_id long, text string")
    fp = {r.doc_id: r.fingerprint for r in fingerprints.text_fingerprints(df).collect()}
    assert fp[1] == fp[2] != fp[3] and fp[5] == "0" * 256
    both = spark.createDataFrame([(fp[3], fp[4], fp[1])], "a string, b string, c string")
    row = both.select(fingerprints.combine(F.col("a"), F.col("b")).alias("plus"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("minus")).first()
    assert (row.plus, row.minus) == (fp[1], fp[3])


def test_fingerprints_on_odd_rows(spark):
    rows = fingerprints.fingerprint_edits(odd(spark), ranges=5).collect()
    assert len(rows) == 12 and {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {"0" * 256}
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one.near_next == 1.0
