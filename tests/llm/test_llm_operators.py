"""Each operator against a brute-force version, on rows with every odd case, and on empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import sys
import time
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import LONG, prose, rows, table, write

from lamellar.llm import common, decontamination, langid, packing, pii, quality, quotes, sharding, simhash, token_files, urls
from lamellar.llm.queries import QUERIES
from lamellar.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(common.WORD)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    pages = [(1, "http://a.net/x"), (2, "https://b.example.net/en/1"), (3, "http://example.com/de/1"), (4, "http://q.org/fr/"), (5, "http://q.com/1"), (6, None), (7, "nothing"), (8, "HTTP://A.NET"), (None, "http://q.com/1?x#y"), (8, "HTTP://A.NET")]
    talk = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday A wrote:\n> How are you?\nFine."), (1, 2, "user", "> > How are you?\n> Fine.\nGood"), (1, 3, "user", "> Hello   THERE.\n> How are you?\nLate reply"), (None, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, None, "> never said")]
    return write(spark, tmp_path_factory.mktemp("odd"), None, [(1, prose(4, 60)), (2, None), (3, "")], [(i, u, None) for i, u in pages], talk)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("text", ["", " ", "a", " a  b", "a\n\n b \n", "a\tb", "it's don't I'LL 'tis", "x.. y,, z.,", "é ü ñ 日本語 😀 ½ ²", "<|endoftext|>", "<|endoftext|> a", "x <|endoftext|> y", "x<|endoftext|>  <|endoftext|><|endoftext|>", "a  <|endoftext|>\n", "<|endoftext| >", "1,2 3.4", "a\r\nb", " a b", "A-b_c", LONG[:5000]])
def test_pieces_give_whole_text_ids(text):
    got = encoder(PATH).encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids_of(text)[:-1]


# ---- 1


def brute_fp(text, width=3):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, ids, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = collections.defaultdict(list)
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)].append(i)
    return [min(least[find(k)], default=None) for k in range(len(fps))]


def test_simhash_query(spark, odd):
    data = rows()
    fps = [brute_fp(r[1]) for r in data]
    want = collections.Counter((r[0], f"{f:016x}", c) for r, f, c in zip(data, fps, brute_components(fps, [r[0] for r in data]), strict=True))
    assert collections.Counter(map(tuple, QUERIES["op1_simhash"](spark, odd).collect())) == want


def test_links_lose_none(spark):
    """Clusters of near fingerprints, some with hundreds in one cell, and chains: the same components as all pairs give."""
    r, fps = random.Random(5), [0, 3, 12, 15 << 60]
    for size in (25, 25, 25, 300):
        centre = r.getrandbits(64)
        fps += [centre] + [centre ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(size)] + [centre ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(size)]
    for _ in range(40):  # chains of two bits
        fps.append(fps[-1] ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    ids = list(range(len(fps)))
    df = simhash.staged(spark.createDataFrame([(i, simhash.signed(f)) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long"), "t")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    assert got == dict(zip(ids, brute_components(fps, ids), strict=True))


def test_grid_cells_meet_within_distance_two(spark):
    """Two points share a cell if and only if their Manhattan distance is two or less; cells are points one step away."""
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = list({b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(8)})
    cells = collections.defaultdict(set)
    for x in simhash.grid_cells(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")).collect():
        assert x.cell not in cells[x.fp]
        cells[x.fp].add(x.cell)
    counts = {f: [(f >> 2 * s & 3).bit_count() for s in range(32)] for f in fps}
    for a, b in itertools.combinations(fps, 2):
        near = sum(abs(x - y) for x, y in zip(counts[a], counts[b], strict=True)) <= 2
        assert near == bool(cells[simhash.signed(a)] & cells[simhash.signed(b)])


def test_embedding_is_a_lower_bound(spark):
    r = random.Random(3)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)]
    df = spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("d"), "a", "b").collect()
    for row in got:
        a, b = row.a & (1 << 64) - 1, row.b & (1 << 64) - 1
        counts = [sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))]
        assert row.d == counts[0] <= (a ^ b).bit_count()


def test_near_copies_are_groups(spark):
    base = prose(11, 300)
    w = base.split()
    near = " ".join(w[:100] + ["changed"] + w[101:])
    far = " ".join(w[:150] + prose(12, 150).split())
    data = [(1, base), (2, base), (3, near), (4, far), (5, prose(13, 200)), (None, base), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, _row string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def brute_near(texts, width=5, similarity=0.8):
    """Group numbers of texts by all pairs of shingle sets."""
    sets = [set().union(*simhash.shingles(t, width)) or {b""} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_groups(spark, texts, **kw):
    df = simhash.staged(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, id long, text string"), "t")
    got = {r.id: r.root for r in simhash.near_copies(df, **kw).collect()}
    return [got.get(i, i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [0, 6])
def test_near_copies_of_a_hub(spark, rounds):
    """Variants close to a hub that isn't the smallest id, mostly not to each other; variants of variants, close to one of them only."""
    r, hub = random.Random(21), prose(21, 200).split()

    def varied(words, n):
        words = list(words)
        for i in r.sample(range(len(words)), n):
            words[i] = f"z{r.randrange(10**6)}"
        return words

    first = [varied(hub, r.choice((2, 3, 4, 5))) for _ in range(250)]
    second = [varied(w, r.choice((3, 4, 5))) for w in first[:80]]
    texts = [" ".join(w) for w in [*first[:125], *second, hub, *first[125:]]]
    want = brute_near(texts)
    assert 1 < len(set(want)) < 150 and near_groups(spark, texts, rounds=rounds) == want


def test_near_copies_recall_by_kind_of_edit(spark, small):
    """Real texts, edited: substitutions, insertions, passages added or cut. Groups equal those of all pairs: recall is 1."""
    r = random.Random(12)
    some = [x.text.split() for x in spark.read.parquet(f"{small}/documents.parquet").where("n_chars between 600 and 6000").orderBy("doc_id").limit(60).collect()]
    texts = [" ".join(w) for w in some]
    for k, w in enumerate(some):
        n, other = len(w), some[(k + 1) % len(some)]
        for share in (0.02, 0.1, 0.15, 0.19):
            m = max(1, int(n * share))
            texts += [" ".join(w[:-m]), " ".join(w[m:]), " ".join(w + other[:m]), " ".join(other[:m] + w)]
            v = list(w)
            for i in r.sample(range(n), max(1, int(n * share / 9))):
                v[i] = f"q{r.randrange(10**6)}"
            texts.append(" ".join(v))
    assert near_groups(spark, texts) == brute_near(texts)


# ---- 2


def test_sharding_query(spark, odd):
    got = QUERIES["op2_sharding"](spark, odd).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) <= set(range(8))


def test_matrix_margins_and_law():
    counts = {0: 10, 1: 3, 2: 0, 3: 25}
    seen = collections.Counter()
    for seed in range(3000):
        m = sharding.communication_matrix(counts, 4, seed)
        cells = {r["part"]: [b - a for a, b in zip([0, *r["ends"]], r["ends"], strict=False)] for r in m}
        assert all(sum(v) == counts[k] and min(v) >= 0 for k, v in cells.items())
        assert [sum(v[s] for v in cells.values()) for s in range(4)] == [10, 10, 9, 9]
        seen[cells[0][0]] += 1
    assert abs(sum(k * v for k, v in seen.items()) / 3000 - 100 / 38) < 0.1  # the mean of the hypergeometric law


def test_hypergeometric_of_huge_counts():
    got = sharding.hypergeometric(random.Random(1), 10**10, 7 * 10**10, 10**6)
    assert abs(got - 125_000) < 2_000


def test_shuffle_uses_all_places(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.uniform_shards(docs, 4, partition_rows=500, bucket_rows=300).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sorted(order) == list(range(4000))
    rises = sum(a < b for a, b in itertools.pairwise(order))
    assert 1800 < rises < 2200


# ---- 3


def test_masks_meet_every_pair_of_substitutions():
    n = decontamination.WINDOW
    for p in itertools.combinations(range(n), decontamination.SUBSTITUTIONS):
        assert any(not any(o + m in p for m in mask) for mask in decontamination.MASKS for o in range(n - mask[-1]))
    for k in range(7, n):
        assert all(any(p not in range(o, o + 3) for o in range(k - 2)) for p in range(k))


def brute_starts(text, item):
    a, b = decontamination.words(text), decontamination.words(item)
    if len(b) < 3:
        return [0] if b and a == b else []
    window, most = decontamination.allowed(len(b))
    return [i for i in range(len(a) - window + 1) if any(sum(x != y for x, y in zip(a[i : i + window], b[j : j + window], strict=True)) <= most for j in range(len(b) - window + 1))]


def brute_spans_of(text, item):
    n, out = len(decontamination.words(item)), []
    for start in brute_starts(text, item):
        end = start + decontamination.allowed(n)[0]
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return out


@pytest.mark.parametrize("filter_bits", [1 << 27, 1 << 15])
def test_decontamination(spark, filter_bits):
    r = random.Random(8)
    items = [(k, prose(100 + k, n)) for k, n in enumerate([40, 20, 13, 9, 4, 2, 1, 7, 3])] + [(17, None), (18, ""), (None, prose(130, 25)), (20, prose(100, 40)), (21, "a b " * 40)]
    data = []
    for k, (_, text) in enumerate(items[:9]):
        for cuts in range(4):
            w = text.split()
            for _ in range(cuts):
                w[r.randrange(len(w))] = "other"
            lo = r.randrange(max(1, len(w) - 14))
            data.append((len(data), f"{prose(200 + k, 30)} {' '.join(w[lo:])}. {prose(300 + cuts, 20)}"))
    data += [(90, None), (91, ""), (None, items[0][1]), (92, prose(999, 300)), (93, items[5][1].upper() + "."), (94, items[6][1]), (95, items[11][1]), (95, items[11][1]), (96, "b a " * 100 + prose(5, 20)), (97, "a b c " * 50)]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in data], "doc_id long, text string, spans string, k1 string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, kind string")
    got = collections.Counter((x.doc_id, x.item_id, x.n_words, x.n_overlap_words, tuple((s.start, s.end) for s in x.spans)) for x in decontamination.overlaps(docs, bench, filter_bits).collect())
    want = collections.Counter()
    for i, t in data:
        for k, item in items:
            if t and item and (spans := brute_spans_of(t, item)):
                want[i, k, len(decontamination.words(t)), sum(b - a for a, b in spans), tuple(map(tuple, spans))] += 1
    assert got == want
    kept = decontamination.decontaminate(docs, bench, filter_bits)
    assert kept.columns == docs.columns
    bad = {i for i, *_ in want}
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in data} - bad


def test_decontamination_by_a_large_benchmark_and_a_repetitive_item(spark):
    """Ten times more benchmark than documents, far more hashes than the filter has bits; one document and item of one word, over and over."""
    items = [(k, prose(5000 + k, 60)) for k in range(400)] + [(1000, "so " * 300)]
    data = [(k, f"{prose(9000 + k, 20)} {items[7 * k][1]}") for k in range(20)] + [(100 + k, prose(9500 + k, 60)) for k in range(18)] + [(200, "so " * 20_000)]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_overlap_words for x in decontamination.overlaps(docs, bench, 1 << 15).collect()}
    assert got == {(k, 7 * k): 60 for k in range(20)} | {(200, 1000): 20_000}


# ---- 4


def brute_stats(text):
    w = WORD.findall(text or "")
    g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c, cover, seen, dup = collections.Counter(g), set(), set(), 0
    for k, x in enumerate(g):
        if c[x] > 1:
            cover.update(range(k, k + 5))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(cover)


def test_quality_query(spark, odd):
    got = QUERIES["op4_quality_rules"](spark, odd).collect()
    want = collections.Counter()
    for r in rows():
        s = brute_stats(r[1])
        want[(r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert collections.Counter((*r[:7],) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "x\nx\n\n \nx\ny", "a a a a a a a", "#* $%\nq & | <>", "é ü b \x0b c"])
def test_text_stats(text):
    assert quality.text_stats(text)[:5] == brute_stats(text)


def test_fences_part_junk_from_prose(spark):
    clean = [(i, prose(i, 60, "abcdefghij"), "en", f"s{i % 3}") for i in range(200)]
    junk = [(1000 + i, " ".join(f"{x}!!" for x in prose(i, 60).upper().split()), "en", "s0") for i in range(10)]
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(200)) == 200 and not any(got[1000 + i] for i in range(10))


# ---- 5


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_query(spark, odd):
    got = QUERIES["op5_url_filter"](spark, odd)
    for r in got.join(spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url").distinct(), "page_id").collect():
        host, path, rule, verdict = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert got.count() == 10


def folded(url):
    return "^" + re.sub(r"[^a-z0./?=&#_%:~+,;@!$'()\[\]-]", "*", re.sub("[0-9]", "0", re.sub(r"^[^:]*://", "", url).lower()))


def markov(ruled, order=3, least=2):
    """Witten-Bell models of both classes by dictionaries: log ratio of a gram's last character. ruled: (text, verdict, rows)."""
    count = {"allow": collections.Counter(), "block": collections.Counter()}
    for text, verdict, n in ruled:
        for i in range(len(text)):
            for k in range(min(order, i) + 1):
                count[verdict][text[i - k : i + 1]] += n
    total = {c: collections.Counter() for c in count}
    kinds = {c: collections.Counter() for c in count}
    for c, grams in count.items():
        for g, n in grams.items():
            total[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1

    def p(c, g):
        h, lower = g[:-1], p(c, g[1:]) if len(g) > 1 else 1 / 64
        return (count[c][g] + kinds[c][h] * lower) / (total[c][h] + kinds[c][h]) if total[c][h] else lower

    grams = {g for c in count.values() for g in c if not g[:-1] or total["allow"][g[:-1]] + total["block"][g[:-1]] >= least}
    known = {g for g in grams if all(g[k:] in grams for k in range(len(g)))}
    return {g: math.log(p("allow", g) / p("block", g)) for g in known}


def markov_score(llr, text, order=3):
    return sum(next((llr[text[a : i + 1]] for a in range(max(0, i - order), i + 1) if text[a : i + 1] in llr), 0.0) for i in range(len(text))) / len(text)


def test_url_scores_and_threshold_by_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    r = random.Random(3)
    more = [(10_000 + i, f"http://{r.choice(['a', 'bb', 'shop'])}{i}.{r.choice(['net', 'org/fr', 'com', 'net/en', 'org'])}/{prose(i, 2).replace(' ', '/')}") for i in range(400)]
    pages = pages.union(spark.createDataFrame(more + more[:50], "page_id long, url string"))
    got = urls.url_verdicts(pages).where("url is not null").collect()
    rows_ = collections.Counter(x.url for x in got)
    ruled = [(u, brute_rule(u)[3], n) for u, n in rows_.items() if brute_rule(u)[3]]
    fold = {u: zlib.crc32(u.encode()) % 5 == 0 for u in rows_}
    llr = markov([(folded(u), v, n) for u, v, n in ruled if not fold[u]])
    score = {u: markov_score(llr, folded(u)) for u in rows_}
    assert all(abs(x.score - score[x.url]) < 1e-9 for x in got)
    # the cut that parts the ruled URLs of the fold best, by 2-digit scores
    tested = [(max(-20.0, min(20.0, round(score[u], 2))), v, n) for u, v, n in ruled if fold[u]]
    bins, of = sorted({s for s, _, _ in tested}), lambda v: sum(n for _, w, n in tested if w == v)
    gain = [sum(n for s, v, n in tested if v == "block" and s < b) / of("block") - sum(n for s, v, n in tested if v == "allow" and s < b) / of("allow") for b in bins]
    best = [i for i, x in enumerate(gain) if x == max(gain)]
    cut = (bins[max(0, best[0] - 1)] + bins[best[-1]]) / 2
    for x in got:
        want = brute_rule(x.url)[3] or ("block" if score[x.url] < cut else "allow")
        assert x.verdict == want or abs(score[x.url] - cut) < 0.011, x  # Python and Spark round halves apart


def test_url_of_200000_characters(spark):
    long = "http://x.com/" + "ab/" * 66_000
    pages = [(1, long), (2, "http://a.net/q"), (3, "http://b.org/fr/x"), (4, long + "z")] + [(10 + i, f"http://{prose(i, 1)}.{('net', 'org')[i % 2]}/fr/{prose(i, 1)}") for i in range(60)]
    begun = time.time()
    got = {x.page_id: x for x in urls.url_verdicts(spark.createDataFrame([(i, u, 1, "x", "y", 2) for i, u in pages], "page_id long, url string, n int, host string, u string, g int")).collect()}
    assert len(got) == 64 and got[1].host == "x.com" and len(got[1].path) == 198_001
    assert time.time() - begun < 90


def test_url_model_learns(spark):
    r = random.Random(2)
    name = lambda letters: "".join(r.choice(letters) for _ in range(8))
    pages = [(i, f"http://{name('abc')}.org/fr/{name('abc')}") for i in range(300)] + [(1000 + i, f"http://{name('xyz')}.net/{name('xyz')}") for i in range(300)]
    asked = [(5000 + i, f"http://{name('abc')}.com/{name('abc')}") for i in range(50)] + [(6000 + i, f"http://{name('xyz')}.com/{name('xyz')}") for i in range(50)]
    got = {x.page_id: x.verdict for x in urls.url_verdicts(spark.createDataFrame(pages + asked, "page_id long, url string")).collect()}
    assert sum(got[5000 + i] == "allow" for i in range(50)) >= 45 and sum(got[6000 + i] == "block" for i in range(50)) >= 45


# ---- 6


def test_quotations(spark, odd):
    got = {(r.conv_id, r.turn): r for r in QUERIES["op6_quotation_linking"](spark, odd).collect()}
    assert [got[1, k].text for k in range(4)] == ["Hello there.\nHow are you?", "Fine.", "Good", "Late reply"]
    assert [got[1, k].parent_turn for k in range(4)] == [None, 0, 1, 0]
    assert [got[1, k].place for k in range(4)] == [0, 1, 2, 3] and [got[1, k].depth for k in range(4)] == [0, 1, 2, 1]
    assert got[2, 1].parent_turn is None and got[None, None].text == ""
    assert QUERIES["op6_quotation_linking"](spark, odd).count() == 8


def test_long_reply_chains(spark):
    talk = [(1, 0, "u", "line number 0")] + [(1, k, "u", f"> line number {k - 1}\nline number {k}") for k in range(1, 20)]
    got = sorted(quotes.conversations(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.turn)
    assert [r.depth for r in got] == list(range(20)) and [r.place for r in got] == list(range(20))


def brute_parents(talk):
    """talk: (turn, text) of one conversation. Row -> row of the message that it quotes."""
    norm = lambda x: " ".join(x.lower().split())
    seen = [[(re.match(r"\s*((?:>\s?)*)", line)[1].count(">") if re.match(r"\s*>", line) else 0, re.sub(r"^\s*(?:>\s?)+", "", line)) for line in text.split("\n")] for _, text in talk]
    out = {}
    for k, lines in enumerate(seen):
        best = None
        for level, run in ((lv, [x for _, x in g]) for lv, g in itertools.groupby(lines, key=lambda x: x[0])):
            if not level:
                continue
            paragraphs = [[norm(x) for x in p.split("\n") if norm(x)] for p in re.split(r"\n\s*\n", "\n".join(run))]
            whole = [norm(x) for x in run if norm(x)]
            for part, piece in [(0, whole), *((1, p) for p in paragraphs), *((2, [x]) for x in whole)]:
                for j in range(len(talk)):
                    own = [norm(x) for lv, x in seen[j] if lv == 0 and norm(x)]
                    if piece and talk[j][0] < talk[k][0] and any(own[i : i + len(piece)] == piece for i in range(len(own))):
                        best = min(best or (99,), (level, part, -talk[j][0], j))
        if best:
            out[k] = best[3]
    return out


def test_random_contiguous_quotes(spark):
    """Quotes of any consecutive lines, at several levels, in several blocks of turns."""
    r, talk = random.Random(9), []
    say = lambda: [prose(r.randrange(10**6), r.randint(1, 5)) if r.random() < 0.8 else r.choice(["yes", "no", "thanks"]) for _ in range(r.randint(1, 6))]
    said = []
    for k in range(90):
        own, text = say(), []
        for level in range(1, 4):
            if said and r.random() < 0.5:
                lines = r.choice(said)
                lo = r.randrange(len(lines))
                text += ["> " * level + x for x in lines[lo : lo + r.randint(1, 4)]]
        said.append(own)
        talk.append((k, "\n".join(text + own)))
    df = spark.createDataFrame([(1, k, "u", t, 0, "x", 5) for k, t in talk], "conv_id long, turn long, role string, text string, row long, c string, part int")
    rows_ = quotes.staged(quotes.parsed(df).withColumn("row", F.col("turn")), "t")
    want = brute_parents(talk)
    assert len(want) > 40
    for block in (1, 7, 1000):
        assert {x.row: x.parent for x in quotes.parents(rows_, block).collect()} == want
    got = {x.turn: x for x in quotes.conversations(df).collect()}
    children, order = collections.defaultdict(list), []

    def walk(k, depth):
        order.append((k, depth))
        for j in children[k]:
            walk(j, depth + 1)

    for k in range(90):
        children[want.get(k)].append(k)
    for k in children[None]:
        walk(k, 0)
    assert [(x.turn, x.depth) for x in sorted(got.values(), key=lambda x: x.place)] == order
    assert sorted(x.place for x in got.values()) == list(range(90)) and all(got[k].parent_turn == want.get(k) for k in got)


def test_deep_chain_and_hot_root(spark):
    """A chain of 3,000 replies, 20,000 replies to one message, and 5,000 messages without conversation and turn."""
    chain = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("> number "), F.col("id") - 1, F.lit("\nnumber "), F.col("id")).alias("text"))
    root = spark.range(20_001).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.when(F.col("id") == 0, F.lit("hello all")).otherwise(F.concat(F.lit("> hello all\nanswer "), "id")).alias("text"))
    none = spark.range(5000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("u").alias("role"), F.lit("lost").alias("text"))
    got = quotes.staged(quotes.conversations(chain.union(root).union(none)), "out")
    assert got.where("conv_id = 1 and (depth <> turn or place <> turn)").count() == 0
    assert got.where("conv_id = 2 and (place <> turn or depth <> least(turn, 1))").count() == 0
    assert got.where("conv_id is null").select("place").distinct().count() == 5000 and got.count() == 28_001


def test_partial_quotes_and_replies_between_quotes(spark):
    talk = [
        (1, 0, "p one\n\np two\n\np three"), (1, 1, "> p two\n>\n> p three\nyes"),
        (2, 0, "l one\nl two\nl three"), (2, 1, "> l two\n> l three\nyes"),
        (3, 0, "first"), (3, 1, "> first\nreply a\nreply b\n> first\nother"), (3, 2, "reply b"), (3, 3, "> reply a\n> reply b\nthanks"),
        (4, 0, "a long line\nthat was wrapped"), (4, 1, "> a long\n> line that was wrapped\nok"), (5, 0, "x\n" * 50_000), (5, 1, "> x\n" * 50_000 + "end"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in talk], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.conversations(df).collect()}
    assert got == {(c, t): None if t in (0, 2) else 1 if (c, t) == (3, 3) else 0 for c, t, _ in talk}


# ---- 7


def test_packing_query(spark, odd):
    got = QUERIES["op7_best_fit_pack"](spark, odd).collect()
    want = collections.Counter()
    for r in rows():
        ids = ids_of(r[1])
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert collections.Counter(tuple(r[:5]) for r in got) == want
    check_sequences(got)


def check_sequences(got):
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        end = 0
        for at, n in sorted(x):
            assert at == end
            end += n
        assert end <= 1024
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            min(fit)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


@pytest.mark.parametrize("seed", range(8))
def test_supersteps_match_every_piece_once(seed):
    """Replays the plans on single gaps: no gap overflows, each piece of each length is placed once, about as few sequences as best-fit decreasing."""
    r = random.Random(seed)
    kinds = [lambda: r.randint(1, 100), lambda: r.choice([30, 31, 34, 50, 100]), lambda: r.randint(20, 60), lambda: min(100, 1 + int(r.expovariate(0.07)))]
    lengths = [kinds[seed % 4]() for _ in range(600)]
    gaps, placed, sequences = {}, collections.Counter(), 0
    for new, plan in packing.supersteps(dict(collections.Counter(lengths)), 100):
        gaps |= {sequences + i: (100, i) for i in range(new)}
        sequences += new
        then = {}
        for g, (size, rank) in gaps.items():
            fit = [p for p in plan if p["size"] == size and p["low"] <= rank < p["high"]]
            assert len(fit) <= 1
            for p in fit:
                i = rank - p["low"]
                placed.update((p["length"], p["first"] + i * p["copies"] + k) for k in range(p["copies"]))
                assert p["left"] == size - p["copies"] * p["length"] >= 0
                then[g] = (p["left"], p["rank_left"] + i)
        assert len(set(then.values())) == len(then)
        gaps = then
    assert placed == collections.Counter((n, k) for n, c in collections.Counter(lengths).items() for k in range(c))
    assert sequences <= best_fit_decreasing(lengths, 100) * 1.02 + 1


def test_packing_takes_few_sequences(spark, small):
    got = QUERIES["op7_best_fit_pack"](spark, small).collect()
    assert check_sequences(got) <= best_fit_decreasing([r.length for r in got], 1024) * 1.005 + 1


# ---- 8


def test_language_query(spark, odd):
    got = QUERIES["op8_language_id"](spark, odd).collect()
    want = collections.Counter((r[0], zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0) for r in rows())
    assert collections.Counter((r.doc_id, r.held_out) for r in got) == want
    text = {r[0]: r[1] for r in rows() if r[0]}
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
        if r.doc_id:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id] or ""))


def test_language_steps_part_languages(spark):
    langs = {"en": "abcde", "de": "abcfg", "fr": "hijkl", "es": "hijmn", "xx": "opqrs"}
    data = [(i, prose(i, 30, letters), lang) for lang, letters in langs.items() for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 40"))
    assert model["families"] == ["germanic", "only xx", "romance"]
    told = langid.identify(docs.where("doc_id >= 40"), model).collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert langid.train(docs.where("doc_id < 0")) is None


def test_held_out_accuracy(spark, small):
    folder = str(Path(small).parent / "sf0.1")
    told = QUERIES["op8_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null and text rlike '[a-z]'").select("doc_id", "lang"), "doc_id").collect()
    assert len(told) > 1500 and sum(r.lang == r.lang_pred for r in told) >= 0.99 * len(told)


def test_language_bound_and_many_languages(spark):
    data = [(i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20 + prose(i, 3), f"l{k:03}") for k in range(40) for i in range(k, 40 * 5, 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=5, most_langs=30)
    assert sorted(x for m in model["members"] for x in m) == [f"l{k:03}" for k in range(30)]


# ---- 9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_pii_query(spark, odd):
    got = QUERIES["op9_pii"](spark, odd).collect()
    want = collections.Counter()
    for r in rows():
        if len(r[1] or "") < 50_000:  # Python's patterns are quadratic on the long ones
            s = brute_spans(r[1])
            want[(r[0], *(sum(x[0] == k for x in s) for k in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    have = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    assert not want - have and sum(have.values()) == len(rows())


def test_base_spans_on_odd_strings(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("1 2+-.@a_b5(0)9é😀") for _ in range(r.randint(5, 60))) for _ in range(400)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0255.1.1.1 00.0.0.256", "4111-1111 1111 1111", "x@y.z@w.v"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("s", pii.base_spans(F.col("text")))
    for x in df.collect():
        assert [(s.kind, s.start, s.end) for s in x.s] == brute_spans(x.text), x.text
        assert all(x.text[s.start : s.end] == s.value for s in x.s)


def test_terms_disclose(spark):
    data = [(i, f"{prose(i, 12)} Kowalczyk x.kow@mail.example {prose(50 + i, 12)}") for i in range(5)] + [(10, f"{prose(90, 20)} KOWALCZYK, {prose(91, 20)}")]
    data += [(1000 + i, prose(400 + i, 40)) for i in range(200)] + [(100 + i, data[0][1]) for i in range(5)]
    page = prose(700, 40).split()  # near copies of one passage tell nothing: a word changes in each, the entity stays
    for i in range(12):
        data.append((200 + i, " ".join([*page[: 14 + i % 8], f"new{chr(97 + i)}", *page[15 + i % 8 : 20], "10.1.2.3", "verbatim", *page[20:]])))
    docs = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, row string")
    spans = {r.kept_doc_id: [s for s in r.spans if s.kind == "term"] for r in pii.find_spans(docs, ["doc_id"]).collect()}
    assert [s.value for s in spans[10]] == ["KOWALCZYK"] and not any(spans[1000 + i] for i in range(200))
    assert not any(spans[200 + i] for i in range(12))
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[TERM] [EMAIL]" in out[0] and "[TERM]," in out[10] and out[1000] == data[6][1] and pii.sanitise(docs).columns == docs.columns


def test_200000_matches_in_one_text(spark):
    n, begun = 200_000, time.time()
    docs = spark.createDataFrame([(1, "a@b.cd 1.2.3.4 " * (n // 2), "x", 3)], "doc_id long, text string, row string, spans int")
    got = pii.find_spans(docs, ["doc_id"]).select("spans").first().spans
    assert len(got) == n and [(s.start, s.end) for s in got[:2]] == [(0, 6), (15, 21)] and (got[-1].start, got[-1].end) == (15 * (n // 2) - 8, 15 * (n // 2) - 1)
    assert time.time() - begun < 120


def test_words_beside_a_span(spark):
    text = "zero " + "x" * 50 + " one two three é@b.c a@b.cd four " + "y" * 30 + " five"
    at = text.index("a@b.cd")
    df = spark.createDataFrame([(text, (at, at + 6))], "text string, s struct<start:int,end:int>")
    near = lambda window, reach: tuple(df.select(*pii.beside(pii.chunks_of(F.col("text")), F.col("s"), window, reach)).first())
    assert near(3, 400) == (["é", "b", "c"], ["four", "y" * 30, "five"])
    assert near(8, 30) == (["one", "two", "three", "é", "b", "c"], ["four"])  # what the reach cuts isn't a word


def test_sanitise_overlaps_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a 4111 1111 1111 1111 b"), (2, None), (3, ""), (4, "q a@b.c 1.2.3.4")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.sanitise(docs).collect()} == {1: "a [CARD] b", 2: None, 3: "", 4: "q [EMAIL] [IP]"}


# ---- 10


def test_token_files_query(spark, odd):
    got = QUERIES["op10_token_files"](spark, odd).collect()
    want = collections.Counter((r[0], len(i), crc(i)) for r in rows() for i in [ids_of(r[1])])
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_shard_file_is_random_access(tmp_path):
    docs = [(k, struct.pack(f"<{k % 7 + 1}I", *range(k, k + k % 7 + 1))) for k in range(50)] + [(None, b"")]
    words = token_files.train_dictionary([d for _, d in docs] * 20, 2048)
    path, n, total = token_files.write_shard(str(tmp_path), 3, docs, words, False, 3)
    r = token_files.ShardReader(str(tmp_path), path, words)
    assert n == len(r) == 51 and total == sum(len(d) // 4 for _, d in docs)
    for k in (50, 0, 17, 49):
        assert (r.doc_id(k), r[k]) == docs[k]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.ShardReader(str(tmp_path), path, b"x")


# ---- common


def test_no_cross_joins(spark, odd):
    """Nor any Python on the executors in the native ones."""
    for name in QUERIES:
        plan = QUERIES[name](spark, odd)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert name not in ("op2_sharding", "op5_url_filter", "op9_pii") or not re.search("MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", plan), name


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (300, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: 0 for k in [*range(1, 41), 100]} | {201: 200}


def test_staged_tables_can_be_cleared(spark):
    df = common.staged(spark.range(3), "gone")
    assert df.count() == 3 and common.clear_staged(spark) >= 1 and common.clear_staged(spark) == 0
