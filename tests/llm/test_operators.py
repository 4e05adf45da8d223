"""The training-data operators against brute force, the libraries and DuckDB, on small tables with every odd case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gazette.llm import bpe, fingerprint, neardup, packing, quality, queries, sharding, suffix_dedup, token_count, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
ODD = [
    "", "  ", None, "x", "One", "one", "a\tb", "a  b\n\nc", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>", "日本語 テキスト 1234 ½²", "é é ̀e", "🙂 👍🏽 x", "b's don't 'LL\n 'll", "a\x1cb c\x85d\xa0e",
    "=-" * 3000 + " end", "x" * 5000, "a" * 100, "a" * 99, "ab" * 300, "q" + "a" * 150, "é" * 200, "\x00\x01 \x7f", "one two", "One TWO", "word " * 300,
]
EMPTY = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    found = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    base = found[3].split()
    for _ in range(20):
        words = list(base)
        for i in rng.sample(range(len(words)), max(1, len(words) // 40)):
            words[i] = f"w{rng.randrange(100)}"
        found.append(" ".join(words))
    return found + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Unique ids, with extra columns whose names clash with those of the operators."""
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}", i, "z", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, _k string, kept boolean").cache()


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, and null and ambiguous ids."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " end", "a"), (None, long, None), (None, "alone", "b"), (3, None, "b"), (3, "other", "b"), (4, "", None)]
    return spark.createDataFrame(rows, EMPTY)


QUERIES = {
    1: quality.judge, 2: token_count.count_tokens, 4: suffix_dedup.digests, 5: fingerprint.fingerprints, 6: packing.pack, 7: bpe.round_trip, 9: neardup.near_duplicates, 10: sharding.shard,
}


@pytest.mark.parametrize("n", QUERIES)
def test_empty_table(spark, n):
    assert QUERIES[n](spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("n", QUERIES)
def test_repeated_rows_keep_their_number(repeated, n):
    rows = QUERIES[n](repeated).collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert ids == {1: 2, 2: 1, None: 2, 3: 2, 4: 1}


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLES[name]).fetch_df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    same_as_sql(spark, name)


def test_quality_rules(docs, texts):
    word = re.compile("[^\x20\x09-\x0d]+")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        words = word.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {j + k for j, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "fine") for i in range(200)] + [(1000 + i, "bad" if i % 10 else good, "foul") for i in range(200)] + [(3000, "bad", "new")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got[1] and not got[0] and not got[1000] and not got[1001]


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_count.count_tokens(docs).collect()}
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(e.ids), len((texts[i] or "").encode()), len(e.ids) > 1024)


def test_url_filters(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.net/en/", "https://net", "https://net/", "http://x.net?/en/", "http://b.example.com/de/x#f", "http://xexample.com/de/x", "http://x.org/fr/", "http://org/frx", None, "", "no scheme", "://", "ftp://a.b.net/x?y", "http://example.net/en"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://z.net/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    one_block = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), block=1)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in one_block.collect()} == got
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host):])[0]
            host = host.lower()
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, *best[1:])


def removed_by_brute_force(rows, size=100):
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - size + 1):
            w = data[i : i + size]
            gone[i : i + size] |= w in seen
            seen.add(w)
        gone = gone[:-1]
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs.select("doc_id", "text")).collect()}
    assert got == removed_by_brute_force(list(enumerate(texts)))


def test_suffix_dedup_of_large_groups(texts, monkeypatch):
    """The steps in one process, with groups so small that all of them are compared by window."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    np.seterr(over="ignore")
    size, gram = 100, 32
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_k", "text"])
    table = pa.Table.from_batches(list(suffix_dedup.find_pieces(size, gram)([batch]))).sort_by([(c, "ascending") for c in ("key", "piece", "doc", "start")])
    judged = pa.Table.from_batches(list(suffix_dedup.judge_pieces(table.to_batches(max_chunksize=37))))
    assert suffix_dedup.SINGLE in judged["kind"].to_pylist()
    lists = [[{"kind": k, "key": h, "start": s, "n": n} for k, h, d, s, n in zip(*(judged[c].to_pylist() for c in ("kind", "key", "doc", "start", "n"))) if d == i] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("kind", pa.int8()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int16())]))
    joined = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, kind)], ["_k", "text", "pieces"])
    cut = pa.Table.from_batches(list(suffix_dedup.cut_bytes(size)([joined]))).sort_by("key")
    ranges = pa.Table.from_batches(list(suffix_dedup.compare_pieces(size)(cut.to_batches(max_chunksize=50))))
    want = removed_by_brute_force(list(enumerate(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for d, s, n in zip(*(ranges[c].to_pylist() for c in ("doc", "start", "n"))):
            if d == i:
                gone[s : s + n + size - 1] = True
        assert int(gone.sum()) == want[i][1]


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(got, reverse=True)
    for i, after in zip(order, [*order[1:], order[0]]):
        t, following = texts[i] or "", texts[after] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].edited_fingerprint == got[i].fingerprint) == (edited == t) or sorted(edited.split("\n")) == sorted(t.split("\n"))
    prints = {}
    for i, t in enumerate(texts):
        prints.setdefault(got[i].fingerprint, set()).add(t or "")
    assert all(len(s) == 1 for s in prints.values())


def test_fingerprints_add_up(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("b. c!\na\n", "a\n", "b. c!\n", "a\nb. c!\n")], "whole string, one string, two string, other string")
    v = lambda c: fingerprint.vector(F.col(c))
    row = df.select(v("whole").alias("w"), fingerprint.add(v("one"), v("two")).alias("s"), fingerprint.add(v("whole"), v("two"), -1).alias("d"), v("one").alias("o"), v("other").alias("x")).first()
    assert row.w == row.s == row.x
    assert row.d == row.o


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces = sorted(packing.pack(docs, window=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = Counter()
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in enumerate(ids)}
    fill = Counter()
    for r in pieces:
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 64 for s in list(sorted(fill))[:-1])


def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe(docs, texts):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_words_are_merged_alike():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeth=- ") for _ in range(rng.randrange(1, 200)))
        assert bpe.merge_long(word, ranks()) == library._core_bpe.encode_single_piece(word)


def test_toxicity_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    right = (got["predicted"] == got["toxic"]).mean()
    found = got[got["toxic"] == 1]["predicted"].mean()
    assert right > 0.97 and found > 0.85


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert {r.score for r in got} == {0.0}
    rows = spark.createDataFrame([(None, "x", None), (None, None, "a")], EMPTY)
    assert [r.held_out for r in toxicity.score_documents(rows, labels).collect()] == [False, False]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def best_segments_by_definition(scores):
    """Ruzzo and Tompa's definition: the best segment (shortest of equals), then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = round(sum(scores[i:j]), 9)
            if s > 0 and (best is None or (s, i - j) > (best[0], best[1] - best[2])):
                best = (s, i, j)
    if best is None:
        return []
    left = best_segments_by_definition(scores[: best[1]])
    right = [(a + best[2], b + best[2]) for a, b in best_segments_by_definition(scores[best[2]:])]
    return [*left, best[1:], *right]


def test_all_maximal_segments():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 30)
        hits = [(i, rng.choice([0.12, 0.3, 0.73, 2.01])) for i in range(n) if rng.random() < 0.3]
        scores = [-toxicity.DRIFT] * n
        for i, w in hits:
            scores[i] = w
        assert [(a, b) for a, b, _ in toxicity.segments(hits)] == best_segments_by_definition(scores)


def test_near_duplicates(docs, texts):
    sets = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root(i), root(i) == i)


def test_shards_fit(docs, texts):
    for limit in (1, 500, 5000, 10**9):
        rows = sharding.shard(docs, limit).collect()
        sizes, members = Counter(), Counter()
        for r in rows:
            sizes[r.shard] += r.n_bytes
            members[r.shard] += 1
        assert len(rows) == len(texts) and not any(a != b and b.startswith(a) for a in sizes for b in sizes)
        assert all(sizes[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or members[r.shard] == 1) for r in rows)


def test_two_tables_hold_every_pair():
    pairs = bpe.pair_table(ranks())
    one, two = bpe.two_tables(pairs)
    for pair, rank in list(pairs.items())[::97]:
        assert pair | rank in (one[pair % len(one)], two[pair % len(two)])


def test_every_piece_has_its_last_merge():
    """One pair for each piece of more than a byte: the merges lead to all of this vocabulary."""
    assert sorted(bpe.pair_table(ranks()).values()) == sorted(r for p, r in ranks().items() if len(p) > 1)


def test_ranks_are_read(tmp_path):
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert bpe.read_ranks(str(path))[b"a"] == 97
