import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import PROSE, ROWS


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# --- sharding


def test_difference_is_even_and_complete():
    from runledger.llm.sharding import difference

    r = random.Random(5)
    sizes = [r.randrange(1, 1000) for _ in range(3000)]
    bins, sums = difference([np.array([s, 0, 0, 0]) for s in sizes])
    own = collections.Counter()
    for s, b in zip(sizes, bins):
        own[int(b[0])] += s
    assert sorted(own.values()) == sorted(sums.tolist()) and max(sums) - min(sums) <= 2
    assert difference([])[0] == [] and difference([np.array([5, 0])])[1].tolist() == [5, 0]


def test_sharding(odd, none):
    from runledger.llm.sharding import assign_shards

    got = assign_shards(odd, n_shards=3, chunk_groups=2, slot_rows=3, whole_up_to=9).collect()
    assert len(got) == len(ROWS)
    texts = collections.defaultdict(list)
    for k, t in ROWS:
        texts[k].append(t)
    slots, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        t = texts[r.doc_id][0]
        assert (r["size"], r.text_crc32) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in groups.values())
    assert assign_shards(none).collect() == []


def test_a_group_beyond_a_shard_is_split(spark):
    from runledger.llm.sharding import assign_shards

    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = collections.Counter()
    for r in assign_shards(df, n_shards=4).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.25 * min(sizes.values())


# --- URL filters


def test_url_filters(spark):
    from runledger.llm.url_filters import filter_captures

    entries = spark.createDataFrame(
        [("a", "block", "domain", "Bad.org", "add", "2024-01-10"), ("a", "block", "domain", "bad.org", "remove", "2024-02-10"), ("a", "block", "domain", "bad.org", "add", "2024-03-10"), ("b", "allow", "domain", "good.bad.org", "add", "2024-01-01"),
         ("c", "block", "prefix", "x.net/en/ads", "add", "2024-01-01"), ("c", "block", "prefix", "x.net/en/ads", "add", "2024-01-02"), ("d", "block", "domain", None, "add", "2024-01-01"), ("e", "block", "domain", "tie.org", "add", "2024-01-05"), ("e", "block", "domain", "tie.org", "remove", "2024-01-05")],
        "list_name string, action string, kind string, pattern string, change string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    cases = [
        ("http://www.bad.org/x", "2024-01-09", False), ("http://www.bad.org/x", "2024-01-10", True), ("https://BAD.org:80?q", "2024-02-10", False), ("http://u@bad.org/", "2024-05-01", True), ("http://good.bad.org/", "2024-05-01", False),
        ("http://notbad.org/", "2024-05-01", False), ("http://x.net/en/ads/1?x#y", "2024-05-01", True), ("http://x.net/en/adsense", "2024-05-01", False), (None, "2024-05-01", False), ("nonsense", "2024-05-01", False), ("http://bad.org/", None, False),
        ("http://tie.org/", "2024-06-01", False), ("http://www.bad.org/x", "2024-01-10", True),
    ]
    df = spark.createDataFrame([(k, u, t, w, "mine") for k, (u, t, w) in enumerate(cases)], "id int, url string, fetched_at string, want boolean, blocked string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = filter_captures(df, entries, bucket_days=7).collect()
    assert len(got) == len(cases) and all(r.blocked == r.want for r in got), [r for r in got if r.blocked != r.want]
    assert filter_captures(df.filter("false"), entries).collect() == [] and not any(r.blocked for r in filter_captures(df, entries.filter("false")).collect())


def test_prefixes_with_trailing_slashes(spark):
    from runledger.llm.url_filters import filter_captures

    entries = spark.createDataFrame(
        [("a", "block", "prefix", "x.net/Ads/ ", "add", "2024-01-01"), ("a", "block", "prefix", "x.net/ads", "remove", "2024-03-01"), ("b", "block", "prefix", "whole.org//", "add", "2024-01-01"), ("c", "block", "prefix", "/", "add", "2024-01-01")],
        "list_name string, action string, kind string, pattern string, change string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    cases = [("http://x.net/ads/1", "2024-02-01", "x.net/ads"), ("http://x.net/ads/", "2024-02-01", "x.net/ads"), ("http://x.net/ads", "2024-02-01", "x.net/ads"), ("http://x.net/adsense", "2024-02-01", None), ("http://x.net/ads/1", "2024-03-01", None), ("http://whole.org", "2024-02-01", "whole.org"), ("http://whole.org/a/b", "2024-02-01", "whole.org")]
    df = spark.createDataFrame(cases, "url string, fetched_at string, want string")
    got = filter_captures(df, entries).collect()
    assert len(got) == len(cases) and all(r.pattern == r.want and r.blocked == (r.want is not None) for r in got)


# --- decontamination


def brute_tiles(item, doc, k):
    """Greedy string tiling by definition."""
    a, b, total = set(), set(), 0
    while True:
        best = (k - 1, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in a and j + n not in b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return total
        n, i, j = best
        a.update(range(i, i + n))
        b.update(range(j, j + n))
        total += n


def test_tiling_against_the_definition(spark):
    from runledger.llm.decontam import find_leaks

    r = random.Random(2)
    docs = [(d, " ".join(r.choice("abcd") for _ in range(r.randrange(40)))) for d in range(60)] + [(99, None), (100, "")]
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 14)))) for i in range(8)] + [(None, "a b c a b c"), (50, None)]
    got = {(x.doc_id, x.item_id): x.tiled_words for x in find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string"), seed=3, coverage=0.5, block_words=5).collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            if i is not None and s:
                n = brute_tiles(s.split(), (t or "").split(), 3)
                if n and n >= 0.5 * len(s.split()):
                    want[d, i] = n
    assert got == want


def test_items_shorter_than_a_seed_are_matched_whole(spark, tmp_path):
    import corpus_pipeline
    from runledger.llm.decontam import find_leaks, op3_query

    r = random.Random(8)
    docs = [(d, " ".join(r.choice("abcd") for _ in range(r.randrange(60))), "en", "s", 0) for d in range(40)] + [(99, None, "en", "s", 0), (100, "", "en", "s", 0)]
    items = [(i, " ".join(r.choice("abcd") for _ in range(n))) for i, n in enumerate((1, 2, 3, 3, 4, 4, 5, 6, 9))] + [(20, "B, C!"), (21, "..."), (22, "zebra")]
    brute = lambda s, t: brute_tiles(s, t, min(5, len(s)))
    want = {}
    for d, t, *_ in docs:
        for i, s in items:
            own = re.findall("[a-z]+", s.lower())
            if own and (n := brute(own, (t or "").split())) and n >= 0.5 * len(own):
                want[d, i] = n
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op3_query(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.doc_id, x.item_id): x.tiled_words for x in got} == want and {1, 2, 3, 4} <= {x.item_words for x in got}
    assert {x.item_words for x in find_leaks(df, bench).collect()} <= {5, 6, 9}
    assert {x.doc_id for x in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_leaks_reordered_and_rewritten(odd, none, spark):
    from runledger.llm.decontam import drop_leaks, find_leaks

    a, b = PROSE.split()[:10], PROSE.split()[10:]
    bench = spark.createDataFrame([(1, " ".join(b).upper() + "!!! " + ", ".join(a))], "item_id int, text string")
    assert {r.doc_id for r in find_leaks(odd, bench).collect()} == {1, 2, 7}
    assert drop_leaks(odd, bench).count() == len(ROWS) - 4 and find_leaks(none, bench).collect() == [] and find_leaks(odd, bench.filter("false")).collect() == []


# --- near-duplicates


def brute_near(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_links_of_chains_survive_a_change_of_the_largest_cluster():
    from runledger.llm.near_dup import link_all

    def components(n, links):
        label = list(range(n))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k in range(n) if label[k] == x) for x in label}

    def edited(s, r):
        return set(r.sample(sorted(s), 60 - r.randrange(1, 5))) | {r.randrange(10**6, 10**9) for _ in range(4)}

    # Links 0-1, 1-3, 2-3, 2-4: the largest cluster moves from {0, 1} to {2, 3, 4} when 1 has been passed over.
    links = [(0, 1), (1, 3), (2, 3), (2, 4)]
    sets = [{10**6 + k} | {x for e, link in enumerate(links) if k in link for x in range(100 * e, 100 * e + 10)} for k in range(5)]
    parts = [np.array(sorted(s), np.uint64) for s in sets]
    assert components(5, link_all(parts, 30)) == components(5, links) and len(components(5, links)) == 1

    r = random.Random(3)
    for n in (2, 4, 6, 9, 14, 25):
        for _ in range(60):
            sets = [{r.randrange(10**6) for _ in range(60)}]
            for _ in range(n - 1):
                sets.append(edited(sets[-1], r))
            r.shuffle(sets)
            links = [(a, b) for a in range(n) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
            assert components(n, link_all([np.array(sorted(s), np.uint64) for s in sets], 85)) == components(n, links)


@pytest.mark.parametrize("large", [False, True])
def test_near_duplicates(spark, large):
    from runledger.llm.near_dup import near_duplicates

    r = random.Random(4)
    rows = list({k: t for k, t in ROWS if k is not None}.items())
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for _ in range(r.randrange(1, 7)):
            own = [f"e{r.randrange(9999)}" if r.random() < 0.02 else w for w in base]
            rows.append((100 + len(rows), " ".join(own)))
    how = {"task_shingles": 100, "query_shingles": 150} if large else {}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, **how).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows, 3, 85)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_copies_do_not_write_all_pairs_of_half_keys(spark, monkeypatch):
    from runledger.llm.near_dup import candidates, half_keys
    from runledger.llm.scratch import Scratch

    sizes, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    m = half_keys(0.8)
    copies = [(k, [k if t == k % (2 * m) else t + 1000 for t in range(2 * m)]) for k in range(40)]  # each differs from the others in one half-key
    classes = spark.createDataFrame(copies, "rep long, halves array<long>")
    assert {(x.node, x.label) for x in candidates(classes, m, Scratch(spark, "few")).collect()} == {(k, 0) for k in range(40)}
    assert max(sizes) <= 40 * 2 * m


def test_few_stragglers_do_not_make_all_pairs_of_a_large_group(spark, monkeypatch):
    from runledger.llm import near_dup
    from runledger.llm.scratch import Scratch

    made, joined = [], near_dup._joined

    def counted(keys, *more):
        made.append(keys.count())
        return joined(keys, *more)

    monkeypatch.setattr(near_dup, "_joined", counted)
    m = near_dup.half_keys(0.8)
    copies = [(k, [k if t == k % (2 * m) else t + 10000 for t in range(2 * m)]) for k in range(1000)]
    # Each shares half of the group's half-keys on either side, none of them at equal places.
    stray = [(k, [t + 10000 if (t + t // m) % 2 == k % 2 else t + 10000 * k for t in range(2 * m)]) for k in (2000, 2001)]
    classes = spark.createDataFrame(copies + stray, "rep long, halves array<long>")
    got = near_dup.candidates(classes, m, Scratch(spark, "stragglers"))
    assert {(x.node, x.label) for x in got.collect()} == {(k, 0) for k, _ in copies + stray}
    assert sum(made) <= 2 * m * len(copies + stray)  # not m * m


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_candidates_are_those_of_all_pairs_of_half_keys(spark, m):
    import random

    from runledger.llm.near_dup import Forest, candidates
    from runledger.llm.scratch import Scratch

    draw = random.Random(m)
    rows = [(k, [1000 * t + draw.randrange(8 * m) for t in range(2 * m)]) for k in range(60)]
    forest, first = Forest(len(rows)), {}
    for k, h in rows:
        for a in h[:m]:
            for b in h[m:]:
                forest.join(first.setdefault((a, b), k), k)
    want = {}
    for k, _ in rows:
        want.setdefault(forest.root(k), []).append(k)
    got = candidates(spark.createDataFrame(rows, "rep long, halves array<long>"), m, Scratch(spark, "all-pairs")).collect()
    assert sorted((x.node, x.label) for x in got) == sorted((k, min(c)) for c in want.values() if len(c) > 1 for k in c)
    assert 1 < len(want) < len(rows)


def test_near_duplicates_odd(odd, none):
    from runledger.llm.near_dup import drop_near_duplicates, near_duplicates

    got = near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 7, 3, 8, 9)} == {(1, 1), (7, 1), (3, 3), (8, 8), (9, 8)}
    assert near_duplicates(none).collect() == []
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 3, 4, 5, 6, 8, 10, 11}


# --- lines


def brute_lines(rows, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(odd, none):
    from runledger.llm.line_dedup import dedup_lines

    for bits, ranges in ((12, 1 << 20), (12, 64), (1 / 4096, 1 << 20)):  # an overfull filter only costs shuffle
        got = dedup_lines(odd.repartition(37), bits_per_line=bits, range_bits=ranges)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr) == brute_lines(ROWS)
    assert got.columns == ["doc_id", "text", "shard", "key", "kept", "n_lines", "n_dropped", "kept_sha256"]
    assert dedup_lines(none).collect() == []


# --- packing


def test_packing(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from runledger.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    got = pack_documents(odd, path, capacity=64, chunk_pieces=5, with_ids=True).collect()
    texts = collections.defaultdict(list)
    for k, t in ROWS:
        texts[k].append(t or "")
    held = collections.defaultdict(list)
    for r in got:
        ids = np.array(tk.encode(texts[r.doc_id][0], add_special_tokens=False).ids + [0], "<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.ids == ids.tolist()
        held[r.sequence_id].append(r)
    for rows in held.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(got) == sum(-(-(len(tk.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for _, t in ROWS)
    assert pack_documents(none, path).collect() == []


def test_sum_of_squares():
    from runledger.llm.packing import cut, sum_of_squares

    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(1, 101, 2000))[::-1]
    bins, offsets = sum_of_squares(sizes, 100)
    assert np.bincount(bins, sizes).max() <= 100 and len(set(zip(bins.tolist(), offsets.tolist()))) == 2000
    assert bins.max() + 1 <= 1.02 * sizes.sum() / 100
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(3, 4) == [(0, 3)]


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    from runledger.llm.packing import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["a", "the", "'s", " ", "  ", "\n", "\t", "é", "²", "½", "12", "_", "-", ".", "!", "<|", "endoftext|>", "\xa0", "\x1c", "\x85", "漢", "😀", "́", "I'll", " "]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# --- WARC


def test_capture_index(spark):
    from runledger.llm.scratch import Scratch
    from runledger.llm.warc import build_index, read_captures, url_key, write_archives

    low = -(1 << 63)
    rows = [(k, f"http://h{k % 3}.org/p?x={k % 5}\r\nX: y#f", f"<p>{'long ' * 300}{k % 4}</p>" if k % 2 else f"short {k % 3}") for k in range(40)]
    rows += [(40, None, None), (None, "http://n.org", "z" * 2000), (None, "http://n.org", "z" * 2000), (None, None, None), (None, None, "n" * 1500), (None, "http://m.org", "n" * 1500), (41, "http://é.org/ü", ""), (5, "http://again.org", "again"), (42, "http://m.org", "z" * 2000), (low, "http://low.org", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    s = Scratch(spark, "t")
    captures = write_archives(pages, f"{s.dir}/a", s, archive_bytes=2000)
    shards = build_index(captures, f"{s.dir}/a", s, shard_lines=9, block_lines=2)
    got = read_captures(captures, shards, f"{s.dir}/a").collect()
    assert len(got) == len(rows) and shards.count() > 1
    tops = collections.defaultdict(lambda: None)
    for k, _, h in rows:
        if k is not None and len(h or "") >= 1000:
            tops[h] = k if tops[h] is None else max(tops[h], k)
    texts = collections.Counter((k, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for k, _, h in rows)
    assert collections.Counter((r.capture, r.payload_digest, r.payload_bytes) for r in got) == texts
    by = {hashlib.sha1((h or "").encode()).hexdigest(): h or "" for _, _, h in rows}
    for r in got:
        top = tops[by[r.payload_digest]]
        revisit = top is not None and (r.capture is None or r.capture < top)
        assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None)) and r.payload == ("" if revisit else by[r.payload_digest])
    assert read_captures(spark.createDataFrame([("org,none)/", 1, True)], "urlkey string, capture long, named boolean"), shards, f"{s.dir}/a").collect() == []
    e = Scratch(spark, "t")
    nothing = write_archives(pages.filter("false"), f"{e.dir}/a", e)
    assert read_captures(nothing, build_index(nothing, f"{e.dir}/a", e), f"{e.dir}/a").collect() == []
    assert url_key("HTTPS://u@www.Example.org:8080/A?b#c") == "org,example,www)/a?b" and url_key("http://a.b?q") == "b,a)/?q" and url_key(None) == ")/"


# --- quality


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, covered, seen, dup = collections.Counter(spans), set(), set(), 0
    for i, s in enumerate(spans):
        if many[s] > 1:
            covered.update(range(i, i + 5))
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(odd, none, spark):
    from runledger.llm.quality import apply_rules, text_statistics

    r = random.Random(9)
    rows = [(k, "".join(r.choice(["a", "b", " ", " ", "\n", "#", "😀"]) for _ in range(r.randrange(80)))) for k in range(150)] + [t for t in ROWS if t[0] is not None]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter((k, brute_statistics(t)) for k, t in rows)
    assert collections.Counter((x.doc_id, tuple(x[n] for n in names)) for x in text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    got = {x.doc_id: x for x in apply_rules(odd, []).collect()}
    assert not got[3].kept and got[3].base_failed and got[10].base_failed and got[1].kept and apply_rules(none, []).collect() == []


def test_decision_list(spark):
    from runledger.llm.quality import FEATURES, fit_rules, keep_good, learn_rules

    r = random.Random(1)
    rows = []
    for k in range(600):
        kind = k % 6
        w = [r.choice(PROSE.split()) + str(r.randrange(99)) for _ in range(40)]
        text = " ".join(x + "###" if kind == 0 else x.upper() + "!!" if kind == 1 else x for x in w)
        rows.append((k, text, int(kind > 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = fit_rules(df)
    kept = {x.doc_id for x in keep_good(df, rules).collect()}
    assert kept == {k for k, _, good in rows if good} and keep_good(df, rules).columns == df.columns
    assert [str(x) for x in fit_rules(df.repartition(5))] == [str(x) for x in rules]
    assert learn_rules([]) == [] and learn_rules([dict.fromkeys(FEATURES, 1.0) | {"bad": 1}] * 9) == []


# --- language


def test_language(spark, odd, none):
    from runledger.llm.langid import predict, train

    r = random.Random(1)
    kinds = {"xx": "aeioklm", "yy": "uwzrstv"}
    rows = [(k, (lang := ("xx", "yy")[k % 2]), " ".join("".join(r.choice(kinds[lang]) for _ in range(5)) for _ in range(20))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = train(df.filter("doc_id < 100").unionByName(spark.createDataFrame([(1, None, "x"), (2, "zz", None)], df.schema)))
    assert model.languages == ["xx", "yy"]
    got = predict(df, model, keep=("doc_id", "lang")).collect()
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in got)
    rest = {x.doc_id: x for x in predict(odd, model).collect()}
    assert (rest[3].lang_pred, rest[3].score, rest[4].lang_pred, rest[5].lang_pred) == ("und", 0, "und", "und") and rest[1].lang_pred != "und"
    assert predict(none, model).collect() == [] and {x.lang_pred for x in predict(df, train(df.filter("false"))).collect()} == {"und"}


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div id=wrap><main><article class="post-17"><h1>Title &amp; co</h1><p><b>One <i>bold</b>text, a &lt; b
 and&nbsp;c<br>next.<p>Two</p><div class="ad-slot">AD</div><ul><li>i1<li>i2</ul><form><p>mail</form><table><tr><td>c1<td>c2</table><section id="comments"><p>a very long reader comment that goes on and on</section></article></main>
<aside>side</aside></div><div class="cookie-notice">cookies</div><footer>f</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_html(spark):
    from runledger.llm.html_text import extract_pages, main_text

    want = "Title & co One boldtext, a < b and c next. Two i1 i2 c1 c2"
    assert main_text(PAGE, None) == want
    tiny = "<body class=other><div class=menu>x y z</div><div><main><article class='post-3'><p>s</p></article></main></div><div class='long-99'><p>" + "more words here " * 9 + "</p></div></body>"
    rows = [(k, "http://h.org/x", PAGE, "mine") for k in range(3)] + [(3, "http://h.org/y", tiny, ""), (4, "http://h.org/z", None, ""), (5, None, "", ""), (6, "nohost", "<p>plain text &am", ""), (7, "http://h.org/x", PAGE[: PAGE.index("next.")] + "<di", "")]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string, n_chars string")).collect()}
    assert got[0].text == want and got[0].n_chars == len(want) and got[3].text == "s", "the host's path decides, not the longest container"
    assert (got[4].text, got[5].text, got[6].text, got[7].text) == ("", "", "plain text &am", "Title & co One boldtext, a < b and c")
    assert extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string, n_chars string").filter("false")).collect() == []


def test_an_article_stands_in_for_its_long_container(spark):
    from runledger.llm.html_text import extract_pages, main_text

    long = "long body words " * 20
    inner = f"<h1>T</h1><p>lead</p><div class=x>{long}</div><div class=y>more</div>"
    want = f"T lead {long}more"
    side = "<div><p>elsewhere</p></div>"
    pages = [f"<body><article>{inner}</article>{side}</body>", f"<body><main>{inner}</main>{side}</body>"]
    assert [main_text(p, None) for p in pages] == [want, want]
    links = "<div class=z><ul>" + "<li><a href=/>one more story</a></li>" * 9 + "</ul></div>"
    assert main_text(f"<main><div class=x>{long}</div>{links}</main>", None) == long.strip()
    rows = [(k, f"http://h{k % 2}.org/", pages[k % 2]) for k in range(4)]
    assert {r.text for r in extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()} == {want}


@pytest.mark.parametrize("name", ["content with-sidebar", "page no-sidebar", "layout has-sidebar", "main hasComments", "wrap--without-header"])
def test_modifiers_are_no_roles(name):
    from runledger.llm.html_text import main_text

    assert main_text(f"<div class='{name}'><p>body text</p><div class=sidebar>s</div></div>", None) == "body text"
    assert main_text("<div class='sidebar with-border'><p>s</p></div><div><p>body text</p></div>", None) == "body text"


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared, leak = prose(30), prose(30)
    rows = [(k, prose(60)) for k in range(60)]
    rows += [(100 + k, prose(40) + " ### ### ### ### ### ### ### ###" * 4) for k in range(20)]
    rows += [(200, rows[0][1] + " x"), (201, prose(50) + "\n" + shared), (202, prose(50) + "\n" + shared), (203, prose(20) + " " + leak), (204, None), (205, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k, _ in rows if k < 120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {x.doc_id: x for x in now.collect()}
    clean = set(range(60)) | {200, 201, 202, 203}
    assert set(ids["quality_rules"]) == clean == set(ids["line_dedup"]) and shared not in ids["line_dedup"][202].text and shared in ids["line_dedup"][201].text
    assert ids["line_dedup"][202].n_chars == len(ids["line_dedup"][202].text)
    assert set(ids["near_dedup"]) == clean - {200} and set(ids["decontamination"]) == clean - {200, 203}
    assert {x.doc_id for x in c.run(spark, str(tmp_path)).collect()} == clean - {200, 203}


def test_near_copies_that_line_dedup_has_emptied(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(9)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    base = [line() for _ in range(12)]
    near = [*base[:-1], line()]
    far = [*base[:4], *(line() for _ in range(8))]
    rows = [(1, "\n".join(base)), (2, "\n".join(near)), (3, "\n".join(far)), (4, "\n".join(base)), (5, line()), (None, "\n".join(base)), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = c.line_dedup(spark, docs, str(tmp_path))
    assert {x.doc_id: x.text for x in left.collect()}[2] == near[-1]
    kept = c.near_dedup(spark, left, str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {1, 3, 5, 6, None} and kept.columns == docs.columns
    # A document that the table does not have takes part with its own text.
    more = left.unionByName(spark.createDataFrame([(9, rows[4][1], "en", "s", 0)], docs.schema))
    assert {x.doc_id for x in c.near_dedup(spark, more, str(tmp_path)).collect()} == {1, 3, 5, 6, None}
    nothing = docs.filter("false")
    assert c.near_dedup(spark, nothing, str(tmp_path)).collect() == [] and c.line_dedup(spark, nothing, str(tmp_path)).collect() == []
