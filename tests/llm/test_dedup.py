"""Exact, near, substring and line dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from odd import nothing, odd  # noqa: F401
from marketpulse.llm import exact, lines, mixing, neardup, substrings
from marketpulse.llm.components import components
from marketpulse.llm.queries import QUERIES


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def id_key(i):
    return (i is None, i or 0)


# ---- exact ----

def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), id_key(m[0])))
        out += [(i, best[0], len(members), (len(t), i) == (len(best[1]), best[0]), hashlib.sha256(text.encode()).hexdigest()) for i, t in members]
    return Counter(out)


@pytest.mark.parametrize("rows_per_filter", [exact.ROWS_PER_FILTER, 7])
def test_exact_groups(odd, rows_per_filter):
    got = Counter(tuple(r) for r in exact.exact_groups(odd, rows_per_filter=rows_per_filter).collect())
    assert got == exact_by_hand(pairs_of(odd))


@pytest.mark.parametrize("rows_per_filter", [exact.ROWS_PER_FILTER, 7])
def test_exact_dedup_keeps_one_row_of_each(odd, nothing, rows_per_filter):
    kept = exact.exact_dedup(odd, rows_per_filter=rows_per_filter)
    assert kept.columns == odd.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in pairs_of(kept)]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in pairs_of(odd)})
    assert exact.exact_dedup(nothing).count() == exact.exact_groups(nothing).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_fingerprinted_once(spark, odd):
    """What filter, single and repeated rows read has the fingerprints stored."""
    assert "sha2" not in plan_of(exact.exact_dedup(odd))


def test_mixture_splits_no_text_again(spark, odd):
    """Whether a row has words is known without splitting its text; the plan of the mixture has the sizes stored."""
    docs = spark.createDataFrame([(1, "a b", "x"), (2, " \t\x0b\x0c\r\n", "x"), (3, None, "x"), (4, "", "x"), (5, "\u00a0", "x")], "doc_id long, text string, source string")
    sized = mixing.mixed(docs, F.array("source"))
    assert {r.doc_id: r.copies > 0 for r in sized.collect() if r.doc_id in (2, 3, 4)} == {2: False, 3: False, 4: False}
    assert sum(r["size"] * r.copies for r in sized.collect()) == 3
    assert "split(" not in plan_of(mixing.mix(docs, F.array("source")))


def test_bloom_filter_misses_no_repeat(spark):
    df = spark.range(4000).select(F.sha2((F.col("id") % 3000).cast("string"), 256).alias("sha"))
    marked = exact._flagged(df.withColumn("id", F.monotonically_increasing_id()), "sha", 4000, "maybe").groupBy("sha").agg(
        F.count("*").alias("n"), F.min("maybe").alias("maybe")).collect()
    assert all(r.maybe for r in marked if r.n > 1)
    assert sum(r.maybe for r in marked if r.n == 1) < 0.1 * 2000


# ---- near ----

def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def groups_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                inter = len(x & y)
                if 100 * inter >= 75 * (len(x) + len(y) - inter):
                    parent[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i, key=id_key)
    return Counter((i, len(sets[k]), first[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def variants(spark):
    """A group whose members are near only to some of the others, a chain, and texts that share a passage."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[j] = f"x{k}_{j}"
        rows.append(" ".join(words))
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        rows.append(" ".join(chain[5 * k:] + [f"d{i}" for i in range(5 * k)]))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [passage + " " + " ".join(f"u{k}_{i}" for i in range(int(rng.integers(5, 40)))) for k in range(40)]
    rows += [" ".join(f"t{i}" for i in range(n)) for n in (1, 2, 4, 5, 6, 7, 8, 9)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_near_groups(spark, odd):
    for df in (odd.select("doc_id", "text"), variants(spark), documents(spark).limit(400)):
        rows = pairs_of(df)
        got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups_by_hand(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_pairs_at_the_threshold_are_linked(spark):
    """Windows of one run of words, so that 3 of 4 shingles of the union are shared; one window in three holds the other, and one in four misses by one."""
    rows, want, number = [], [], 0
    for k in range(3600):
        union = 4 * (4 + k % 62)
        words = [f"w{number + j}" for j in range(union + 4)]
        number += len(words)
        left = (union // 4) * (k % 3) // 2
        near = k % 4 != 3
        rows += [(2 * k, " ".join(words[:union + 4 - left])), (2 * k + 1, " ".join(words[union // 4 - left + (not near):]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert (4 * len(a & b) >= 3 * len(a | b)) == near
        want += [2 * k, 2 * k if near else 2 * k + 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_groups(docs).collect()}
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_full_postings_list_every_linked_pair_together(spark):
    """Drawn sets that share 0.75 and more of their union meet in a list; sets that share two thirds of a common core do not."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate([core[:200], rng.integers(0, 1 << 62, 100)])) for _ in range(60)]
    for k in range(80):
        base = rng.integers(0, 1 << 62, int(rng.integers(5, 120)))
        sets += [base, np.concatenate([base, rng.integers(0, 1 << 62, len(base) // 3)])]  # contained, at 0.75
        turned = base.copy()
        turned[:len(base) // 7] = rng.integers(0, 1 << 62, len(base) // 7)
        sets.append(turned)
    frame = spark.createDataFrame([(i, sorted(map(int, s))) for i, s in enumerate(sets)], "node long, values array<long>")
    posted = neardup._full_postings(frame.select("node", F.size("values").cast("long").alias("n")), frame).collect()
    lists = {}
    for r in posted:
        lists.setdefault(r.value, set()).add(r.node)
    met = {(a, b) for m in lists.values() for a in m for b in m if a < b}
    plain = [set(map(int, s)) for s in sets]
    linked = {(a, b) for a in range(len(plain)) for b in range(a + 1, len(plain)) if 4 * len(plain[a] & plain[b]) >= 3 * len(plain[a] | plain[b])}
    assert len(linked) > 100 and linked <= met
    assert not any(a < 60 and b < 60 for a, b in met)


def test_copies_changed_in_different_places_are_not_paired(spark, monkeypatch):
    """Members share most of a base but lost different parts: lists hold them all, and pairs that can't be linked are not compared."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(160):
        words = [f"b{i}" for i in range(200)]
        for j in rng.choice(40, 2 + k % 5, replace=False):
            words[5 * j] = f"x{k}_{j}"
        rows.append((k, " ".join(words)))
    compared, linked = [], neardup._linked

    def counted(pairs, nodes, sets):
        compared.append(pairs.count())
        return linked(pairs, nodes, sets)

    monkeypatch.setattr(neardup, "_linked", counted)
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = groups_by_hand(rows)
    assert 20 < len({c for _, _, c in want}) < 140
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert compared[-1] < 3000


def test_alike_keeps_all_linked_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60_000):
        union = 16 + 4 * (k % 3)
        h = np.unique(rng.integers(0, 1 << 63, union)).tolist()
        rows.append((h[:union - union // 8], h[union // 4 - union // 8:]))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>")
    pairs = pairs.select(F.size("a").alias("n_a"), F.size("b").alias("n_b"), *(F.transform(c, lambda v: v.bitwiseAND(0x7FFFFFFF).cast("int")).alias(c) for c in "ab"))
    assert pairs.where(~neardup._alike("a", "b")).count() == 0


def test_near_dedup_keeps_one_of_each_group(odd, nothing):
    kept = neardup.near_dedup(odd)
    assert kept.columns == odd.columns
    want = groups_by_hand(pairs_of(odd))
    alone = sum(n for (i, size, c), n in want.items() if not size)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.count() <= len({c for (i, size, c) in want if size}) + alone
    assert {c for (i, size, c) in want if size} <= set(ids) and ids[12] <= 1
    assert neardup.near_dedup(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


# ---- substrings ----

def removed_by_hand(rows, length=substrings.LENGTH):
    seen, out = set(), Counter()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        change = np.zeros(len(data) + 1, int)
        for k in range(len(data) - length + 1):
            window = data[k:k + length]
            if window in seen:
                change[k] += 1
                change[k + length] -= 1
            seen.add(window)
        gone = np.cumsum(change)[:-1] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 300))
        data = rng.integers(97, 99, n).astype(np.uint8)
        ends = np.append(np.sort(rng.choice(np.arange(1, n), min(3, n - 1), replace=False)), n)
        region = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        order = substrings.suffix_array(data, region)
        suffixes = [data[i:region[i]].tobytes() for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(n))
        found = substrings.common_prefixes(data, region, order, 20)
        for a, b, m in zip(suffixes, suffixes[1:], found[1:]):
            assert m == next((k for k in range(21) if k == 20 or a[k:k + 1] != b[k:k + 1] or not a[k:k + 1]), 20)


def test_slices_carry_only_the_documents_of_their_entries():
    """What a slice holds grows with its entries, however many documents the shards have."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 40, 3000)
    starts, ids = np.cumsum(lengths) - lengths, rng.permutation(3000).astype(np.int64)
    places = np.sort(rng.choice(lengths.sum(), 500, replace=False))
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    rows = list(substrings._sliced(7, ids, starts, hashes, [places, hashes], 100))
    found = {}
    for row in rows:
        assert len(row[2]) == len(row[3]) <= 2 * len(row[4])
        shard, doc, place, one = substrings._gathered([row])
        found |= {p: (s, d, h) for s, d, p, h in zip(shard.tolist(), doc.tolist(), place.tolist(), one.tolist())}
    owner = np.repeat(ids, lengths)
    assert found == {p: (7, int(owner[p]), h) for p, h in zip(places.tolist(), hashes.tolist())}


@pytest.mark.parametrize("shard", [3000, substrings.SHARD_BYTES])
def test_remove_repeats(spark, odd, nothing, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    rng = np.random.default_rng(1)
    passages = ["".join(rng.choice(list("abcdefgh "), 180)) for _ in range(4)]
    mixed = [(i, "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 400)))) + passages[i % 4][:int(rng.integers(90, 180))] + "tail" * int(rng.integers(0, 60)))
             for i in range(60)]
    mixed += [(100, None), (101, ""), (None, passages[0]), (102, passages[1] * 3)]
    for rows in (mixed, [r for r in pairs_of(odd) if r[0] is not None and (r[0] != 12)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = Counter(tuple(r) for r in substrings.remove_repeats(df).drop("kept_bytes").collect())
        assert got == removed_by_hand(rows)
    assert substrings.remove_repeats(nothing).count() == 0


# ---- lines ----

def test_edits_by_hand():
    """Against a table filled row by row, on drawn lines of few and many characters, empty ones and ones beyond a machine word."""
    rng = np.random.default_rng(6)
    for k in range(300):
        letters, size = 1 + k % 7, int(rng.integers(0, 30 if k % 2 else 200))
        x = rng.integers(97, 97 + letters, size).astype(np.uint32)
        y = np.concatenate([c for c in np.split(x, np.sort(rng.integers(0, size + 1, k % 9))) for c in (c[int(rng.integers(0, 2)):], rng.integers(97, 105, int(rng.integers(0, 3))))]).astype(np.uint32)
        row = np.arange(len(y) + 1)
        for i, c in enumerate(x):
            step = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != c))])
            row = np.minimum.accumulate(step - np.arange(len(y) + 1)) + np.arange(len(y) + 1)
        assert lines._edits(x, y) == lines._edits(y, x) == row[-1]


def lines_by_hand(spark, df):
    """Kept lines, from the operator's own normal form, all pairs compared by edit distance alone."""
    rows = lines.document_lines(df, "doc_id", "text").where(F.char_length("normal") >= lines.MIN_CHARS).select("id", "line", "normal").collect()
    texts = list({r.normal for r in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    for x, a in enumerate(texts):
        for b in texts[:x]:
            longer = max(len(a), len(b))
            apart = max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total())  # no more than the edits
            if apart * lines.EDITS <= longer and distance(a, b) * lines.EDITS <= longer:
                parent[find(a)] = find(b)
    first = {}
    for r in rows:
        first.setdefault(find(r.normal), []).append((id_key(r.id), r.line))
    return Counter((r.id, r.line, (id_key(r.id), r.line) == min(first[find(r.normal)])) for r in rows)


def test_line_groups(spark, odd, nothing):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(60)]
    made = []
    for k in range(30):
        line = list(words)
        if k % 3:
            line[int(rng.integers(60))] = f"other{k % 7}"
        made.append((k, " ".join(line) + f"\nshort\n{' '.join(rng.choice(words, 12))}"))
    for df in (spark.createDataFrame(made, "doc_id long, text string"), odd.where("doc_id not in (9, 15) or doc_id is null").select("doc_id", "text")):
        got = Counter((r.doc_id, r.line, r.kept) for r in lines.line_groups(df).collect())
        assert got == lines_by_hand(spark, df)
    out = lines.line_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r.text for r in out.where("doc_id = 13").collect()] == ["the same line of text that repeats here again"]
    assert lines.line_dedup(nothing).count() == lines.line_counts(nothing).count() == 0


def test_nodes_are_listed_under_all_shared_grams(spark):
    """Two nodes that share only their commonest gram meet, also where the list is long, unless their lengths rule a link out."""
    far = lambda n: [((1000 * n + k) << 2) + 1 for k in range(15)]
    made = [(0, 100, [*far(1), 5]), (1, 90, [*far(2), 5]), (2, 100, far(1)), (3, 90, far(2)), (4, 60, [5])]
    for extra in (0, 2 * lines.SPLIT):
        rows = made + [(10 + k, 300, [5]) for k in range(extra)]
        nodes = spark.createDataFrame(rows, "node long, n int, grams array<long>")
        listed = [r for i in range(3) for r in lines._postings(nodes, i, 3).collect()]
        under = {node: {r.value for r in listed if r.node == node} for node in range(5)}
        assert under[0] & under[1] and len(under[0] & under[2]) == len(under[1] & under[3]) == 15
        assert not extra or not under[0] & under[4]
    big = spark.createDataFrame([(i, n, [5]) for i, n in enumerate([100, 90, 1000, 900, 69, 63, 200, 180, 30, 27] + [5000] * 40)], "node long, n int, grams array<long>")
    under = {}
    for r in lines._postings(big).collect():
        under.setdefault(r.node, set()).add(r.value)
    assert all(under[i] & under[i + 1] for i in range(0, 10, 2))


def test_lines_with_replaced_words_and_letters_are_found(spark):
    """Of pairs of lines within the edit rule nine in ten at least are one group, whatever their length."""
    rng = np.random.default_rng(7)
    letters = list("etaoinshrdlucmfwyp")

    def word():
        return "".join(rng.choice(letters, int(rng.integers(3, 8))))

    made, kinds = [], []
    for kind, count in (("word", 12), ("word", 20), ("word", 40), ("word", 150), ("letters", 7), ("letters", 40)):
        for _ in range(60):
            line = [word() for _ in range(count)]
            other = list(line)
            if kind == "word":
                at = int(rng.integers(count))
                other[at] = "".join(rng.choice(letters, min(len(line[at]), len(" ".join(line)) // lines.EDITS)))
                if len(line[at]) > len(other[at]):
                    other[at] += line[at][len(other[at]):]
                other = " ".join(other)
            else:
                other = list(" ".join(line))
                for at in rng.choice(len(other), len(other) // lines.EDITS, replace=False):
                    if other[at] != " ":
                        other[at] = str(rng.choice(letters))
                other = "".join(other)
            made += [(2 * len(kinds), " ".join(line)), (2 * len(kinds) + 1, other)]
            kinds.append((kind, count))
    judged = [len(made[2 * i][1]) >= lines.MIN_CHARS for i in range(len(kinds))]
    kept = {r.id: r.kept for r in lines.line_groups(spark.createDataFrame(made, "id long, text string"), "id").collect()}
    for kind in set(kinds):
        found = [not kept[2 * i + 1] for i, k in enumerate(kinds) if k == kind and judged[i]]
        assert len(found) >= 30 and sum(found) >= 0.9 * len(found), (kind, sum(found), len(found))


def test_queries_cover_all_documents(spark):
    n = documents(spark).count()
    for name in ("op2_minhash_near_dedup", "op5_suffix_array_dedup", "op9_fuzzy_line_dedup"):
        assert QUERIES[name](spark, SMALL).count() == n
