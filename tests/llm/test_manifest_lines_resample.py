"""Merkle manifest, line dedup and importance resampling against brute force: nulls, ties, repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendlens.llm import lines, merkle, resample
from trendlens.session import settle

# columns that the operators use themselves must not disturb them
KIND = ("doc_id long, source string, lang string, n_chars long, text string, tree int, idx string, line string, key int, n int, rank int, "
        "score double, place int, row int, weight int, drop int, me int")
JUNK = (1, "x", "y", 2, 3, 4, 5.0, 6, 7, 8, 9, 10)


def table(spark, rows):
    return settle(spark.createDataFrame([(*r, *JUNK) for r in rows], KIND))


def hexed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hexed(below[i: i + 3]) for i in range(0, len(below), 3)])
    return levels


def brute_proof(levels, at):
    out = []
    for row in levels[:-1]:
        first = at - at % 3
        out.append((at - first, [x for i, x in enumerate(row[first: first + 3]) if first + i != at]))
        at //= 3
    return out


def brute_merkle(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, kept = [], []
    for name in names:
        kept.append(sorted(((r[0] is not None, r[0] or 0, hexed(map(field, r)), r) for r in groups[name]), key=lambda x: x[:3]))
        trees.append(brute_tree([x[2] for x in kept[-1]]))
    top = brute_tree([t[-1][0] for t in trees])
    out = Counter()
    for n, (tree, mine) in enumerate(zip(trees, kept)):
        for at, (_, _, leaf, r) in enumerate(mine):
            proof = brute_proof(tree, at) + brute_proof(top, n)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = hexed(map(field, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))
            for place, others in proof:
                node = hexed([*others[:place], node, *others[place:]])
            out[(r[0], leaf, tree[-1][0], top[-1][0], hexed(s for _, o in proof for s in o), node, node == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("sizes", [[1], [0, 250, 1, 0, 3, 82], [81]])
def test_manifest_brute_force(spark, sizes):
    rows = []
    for s, n in enumerate(sizes):
        for i in range(n):
            text = [None, "", "a\nb\n", f"é{i}\n😀", "x" * 5000][i % 5]
            rows.append((None if i == 7 else i // 2, None if s == 1 else f"s{'é' * s}", None if i % 3 else "en", i, text))
    rows += [rows[0]] * 5
    got = merkle.manifest(table(spark, rows), merkle.COLUMNS, tampered=merkle.tampered_digest(merkle.COLUMNS))
    done = merkle.verify(merkle.prove(got, got.leaves, ["key", "tampered"]), "tampered")
    have = Counter((r.key, bytes(r.digest).hex(), bytes(r.subroot).hex(), bytes(r.root).hex(), bytes(r.siblings).hex(),
                    bytes(r.folded).hex(), r.folded == r.root) for r in done.collect())
    assert have == brute_merkle(rows)


def test_manifest_proves_some_leaves_and_none_of_an_empty_table(spark):
    rows = [(i, f"s{i % 2}", "en", 1, str(i)) for i in range(300)]
    got = merkle.manifest(table(spark, rows), merkle.COLUMNS)
    some = merkle.prove(got, got.leaves.where("key in (5, 250)").select("tree", "idx", "leaf"), ["leaf"]).collect()
    assert sorted((r.tree, r.idx) for r in some) == [(0, 125), (1, 2)]
    assert all(r.leaf == r.digest and r.proof[0].place == r.idx % 3 for r in some)
    none = merkle.manifest(table(spark, rows).limit(0), merkle.COLUMNS)
    assert merkle.prove(none, none.leaves, ["key"]).count() == 0


def brute_lines(rows, least):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    each = [(r[0], (r[4] or "").split("\n")) for r in rows]
    seen = Counter(k for _, own in each for k in {key(x) for x in own} if k)
    out = Counter()
    for doc, own in each:
        kept = [x for x in own if seen[key(x)] < least]
        out[(doc, len(own), len(own) - len(kept), "\n".join(kept))] += 1
    return out


def test_line_stages_have_an_effect(spark, folder, monkeypatch):
    """A key found common in a merge is left out of later batches; asking for the common keys writes nothing."""
    docs = [(i, f"always\nown {i}\npair {i // 2}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    always, held, unchanged = hashlib.md5(b"always").digest(), [], []
    frequent = lines.LineRuns.frequent

    def spied(runs):
        before = dict(runs.tables), dict(runs.runs)
        held.append(runs.spark.table(runs.tables[0]).where(F.col("line") == F.lit(always)).count())
        found = frequent(runs)
        unchanged.append(before == (runs.tables, runs.runs))
        return found

    monkeypatch.setattr(lines.LineRuns, "frequent", spied)
    got = lines.op12_lines(spark, folder).collect()
    assert len(got) == 300 and all((r["n_lines"], r["n_dropped"]) == (3, 1) for r in got)
    assert held == [0] and unchanged == [True]


def test_lines_brute_force(spark):
    texts = [None, "", "\n", "a", " A \n\tb\x0b\n\nÀ", "À\nà\n a", "b\r\nB\nb", "x" * 9000 + "\nA", "only\x1fa\nl1", "a\n\n\n"]
    rows = [(None if i % 9 == 0 else i // 2, "s", "en", 1, t) for i, t in enumerate(texts * 3)] + [(1, "s", "en", 1, "c\nd")] * 12
    docs = table(spark, rows)
    for least, fanout in ((10, 2), (3, 4), (1, 2), (2, 9)):
        runs = lines.LineRuns(spark, min_docs=least, fanout=fanout, buckets=3)
        part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(5))
        for b in range(5):
            runs.add(runs.counted(docs.where(part == b)))
        common = settle(runs.frequent())
        runs.close()
        got = Counter(tuple(r) for r in lines.without_lines(docs, common).collect())
        assert got == brute_lines(rows, least)
    none = lines.LineRuns(spark)
    assert none.frequent().count() == 0
    none.add(none.counted(docs.limit(0)))
    assert none.frequent().count() == 0
    assert lines.without_lines(docs.limit(0), none.frequent()).count() == 0
    none.close()
    longer = lines.LineRuns(spark, min_docs=1, min_chars=2)
    longer.add(longer.counted(docs))
    assert hashlib.md5(b"a").digest() not in {bytes(r.line) for r in longer.frequent().collect()}
    longer.close()


def brute_resample(rows, target, percent, least, n, buckets=10_000):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(words), [zlib.crc32(" ".join(words[i: i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    own = [features(r[4]) for r in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    whole, goal = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(whole + buckets) / (float(s[b] + 1) * float(goal + buckets)))) for b in s}
    out = []
    for r, (n_words, f) in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words >= least])
    able = sorted((o for o in out if o[5]), key=lambda o: (-o[3], o[0] is not None, o[0] or 0))
    for place, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = place
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize("n", [1, 3])
def test_resample_brute_force(spark, n):
    texts = [None, "", "...", "A b1 É日本 x-y", "one two three four five", "the same words the same words", "z " * 3000]
    rows = [(None if i == 11 else i // 3, "s", "en", 1, texts[i % 7]) for i in range(90)] + [(4, "s", "en", 1, texts[4])] * 9
    target = ["one two three", None, "É same"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for percent, least in ((10, 5), (100, 0), (37, 2), (10, 10 ** 6)):
        got = Counter(tuple(r) for r in resample.resample(table(spark, rows), goal, percent, least, 2024, n).collect())
        assert got == brute_resample(rows, target, percent, least, n)
    assert resample.resample(table(spark, rows).limit(0), goal.limit(0)).count() == 0


def test_kth_by_quickselect(spark):
    rows = spark.range(2000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("b"), "id")
    order = sorted(((r.a, r.b, r.id) for r in rows.collect()), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2]))
    for k in (1, 2, 777, 1999, 2000):
        assert tuple(resample.kth(rows, ["a", "b", "id"], k, pivots=3)) == order[k - 1]
    assert resample.kth(rows, ["a", "b", "id"], 2001) is None


def test_features_of_runs():
    words, hit, first = resample.feature_buckets(pa.array(["a b c", None, "A"]), 2, 1 << 40)
    assert words.tolist() == [3, 0, 1] and first.tolist() == [0, 5, 5, 6]
    assert hit.tolist() == [zlib.crc32(x) for x in (b"a", b"b", b"c", b"a b", b"b c", b"a")]
