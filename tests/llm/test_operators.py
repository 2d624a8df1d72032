"""Operators of the training-data package against brute force, with nulls, empty and repeated rows, ties, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trendlens.llm import bpe, chat, components, fingerprints, jaccard, language, packing, substrings, urls, vectors, warc
from trendlens.session import settle

TEXT = "doc_id long, text string, lang string, junk string"
EDGES = ["", " ", "\n\n  \n", "a", "don't  stop'll ''s !'s\n x", "日本 語 ２ ½", "é" * 3000 + " b", "x " * 2000, "<|turn|>\\<|end|>", None]


def table(spark, rows, kind=TEXT):
    return settle(spark.createDataFrame(rows, kind))


def doc_rows(texts, start=0):
    return [(start + i, t, "en", "x") for i, t in enumerate(texts)]


def find_root(parent, v):
    while parent[v] != v:
        v = parent[v]
    return v


def brute_components(ids, links):
    parent = {v: v for v in ids}
    for a, b in links:
        x, y = find_root(parent, a), find_root(parent, b)
        parent[max(x, y)] = min(x, y)
    return {v: find_root(parent, v) for v in ids}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def thue_morse(bits):
    """A text whose letters follow the Thue-Morse sequence, and its mirror: sums of powers cannot tell them apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11])
def test_no_hash_takes_mirrored_texts_for_the_same(spark, bits):
    import public_tokenizers as P
    import pyarrow as pa
    import tiktoken

    a, b = thue_morse(bits)
    docs = table(spark, doc_rows([a, b])).coalesce(1)
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect()}
    assert [bytes(got[i].decoded).decode() for i in (0, 1)] == [a, b]
    own = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    pieces = {r.doc_id: r for r in packing.token_pieces(docs, own, P.PATTERN, 1 << 20).collect()}
    for i, text in enumerate((a, b)):
        assert pieces[i].ids_crc32 == zlib.crc32(np.array([*library.encode_ordinary(text), 0], "<u4").tobytes())
    ends = [f"{a} one two three four", f"{b} one two three four"]
    sets = jaccard.shingle_sets(pa.array(ends), 5)
    assert not set(sets[0].tolist()) & set(sets[1].tolist())
    prints = fingerprints.simhash(pa.array(ends))
    assert (prints[0] != prints[1]).any()
    around = " ".join(f"w{i}" for i in range(30))
    cut = substrings.remove_repeats(table(spark, doc_rows([f"{around} {x} {around}" for x in (a, b)])))
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {0: 0, 1: 0}
    words_of = [" ".join(x) for x in (a, b)]  # the same with letters as words, in windows of the whole length
    cut = substrings.remove_repeats(table(spark, doc_rows(words_of)), 1 << bits)
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {0: 0, 1: 0}


# ---------------------------------------------------------------- 1 encoding

def test_bpe_same_as_library_and_round_trip(spark, sf):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\xa0", "ab", "É", "12", "½", "!", "​", "\x1c", "字", "😀", "'re"]
    texts = EDGES + ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(200)]
    docs = table(spark, doc_rows(texts) + [(None, "null id", None, None), (3, "a", "en", "x")])
    got = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    want = Counter((r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode())
                   for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_decode_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, 1, bytearray(np.array([9], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary")
    with pytest.raises(Exception, match="not in the table"):
        bpe.decode(rows, {b"a": 0, b"b": 1}).collect()


# ---------------------------------------------------------------- 2 vectors

def test_vectors_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, vec = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((vec, [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, .05, .2])], label, "x"))
                vec += 1
    rows += [(vec, None, 0, "x"), (vec + 1, [0.0] * 16, 0, "x"), (vec + 2, [float("nan")] * 16, 0, "x"), (vec + 3, [], 0, "x"),
             (vec + 4, [None] * 16, 0, "x"), (vec + 5, [1.0, 2.0], 0, "x"), (vec + 6, [2.0, 4.0], 0, "x"), (vec + 7, [float("inf")] * 16, 0, "x")]
    frame = table(spark, rows, "vec_id long, embedding array<float>, label int, junk string")

    def sound(e, label):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    links = []
    for a, e, la, _ in rows:
        for b, f, lb, _ in rows:
            if a != b and la == lb and sound(e, la) and sound(f, lb) and len(e) == len(f):
                x, y = np.array(e, float), np.array(f, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a, b))
    count, part = Counter(a for a, _ in links), brute_components([r[0] for r in rows], links)
    assert len(links) > 100
    for tile in (2048, 7):  # also with lists cut in many tiles
        got = vectors.near_duplicates(frame, tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
            v: (count[v], part[v], part[v] == v) for v in part}
    twice = table(spark, [(1, [1.0, 0.0], 0, "x")] * 2 + [(None, [1.0, 0.0], 0, "x")], "vec_id long, embedding array<float>, label int, junk string")
    assert sorted(r.n_links for r in vectors.near_duplicates(twice).collect()) == [0, 1, 1]
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 99), (5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


# ---------------------------------------------------------------- 3 chat

def test_chat_reads_back_what_went_in(spark):
    hostile = "<|turn|>user<|text|>x<|end|> \\ \\\\ <\\|end|> </s>[INST] $1 \\E"
    rows = [(1, 0, "user", hostile, 1), (1, 1, "assistant", hostile, 1), (2, 0, "assistant", "first", 1), (3, 0, None, None, 1),
            (4, None, "user", "null turn", 1), (4, 0, "assistant", "", 1), (5, 0, "user", "tie", 1), (5, 0, "user", "tie", 1),
            (None, 0, "system", "s", 1), (None, 1, "user", "é😀", 1)]
    frame = table(spark, rows, "conv_id long, turn long, role string, text string, extra int")
    done = chat.format_chats(frame)
    got = {r.conv_id: r for r in done.select("*", chat.read_back(done.formatted).alias("back")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].back] == [t[1:] for t in turns]
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert [s.loss for s in got[conv].segments] == [x for t in turns for x in (False, t[1] == "assistant", False)]
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, 4: True, 5: False, None: True}
    spans = chat.loss_spans(done).where("loss").collect()
    assert all(got[s.conv_id].formatted[s.start: s.start + s.length] in (chat_escape(r[3]) for r in rows if r[3] is not None) for s in spans)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chats(frame.limit(0)).count() == 0


def chat_escape(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


# ---------------------------------------------------------------- 4 Jaccard

def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j: j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def near_copies(seed, groups=25, common="the same long passage is in every one of these many texts and it says nothing new at all"):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = random.choices(vocabulary, k=random.randint(3, 90))
        for _ in range(random.randint(1, 5)):
            t = list(base)
            for _ in range(random.randint(0, 3)):
                t[random.randrange(len(t))] = random.choice(vocabulary)
            texts.append(" ".join(t if random.random() < .5 else t + common.split()))
    return texts + [common] * 3 + [common.upper(), "one two", "One  two", "three"]


@pytest.mark.parametrize("frequent", [64, 2])
def test_jaccard_brute_force(spark, frequent):
    texts = dict(enumerate(near_copies(6) + EDGES))
    sets = brute_sets(texts)
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = brute_components(texts, links)
    docs = table(spark, [(i, t, "en", "x") for i, t in texts.items()])
    got = jaccard.jaccard_components(docs, frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), part[i]) for i in texts}
    assert len(set(part.values())) < len(texts) - 12


def test_jaccard_null_ids_and_no_rows(spark):
    docs = table(spark, [(None, "a b c d e f", "en", "x"), (7, "a b c d e f", "en", "x"), (5, "a b c d e f", "en", "x"), (5, "q", "en", "x")])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (None, None)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 5 language

def test_phrases_are_longest_matches():
    texts = {"x": "abracadabra abba", "y": "the cat and the hat"}
    model = language.fit(texts)
    flat, roots = language.transition_table(model)
    table_of = language.symbol_table(model["letters"])
    for probe in ["abracadabra", "the hat abba", "cat", "zzz", "a" * 1200]:
        points, rows = language.code_points([probe])
        got = language.phrases(table_of[points].astype(np.int32), rows, flat, roots)[0]
        for k, known in enumerate(texts.values()):
            count = 0
            for at in range(0, len(probe), language.STRETCH):
                part, i = probe[at: at + language.STRETCH], 0
                while i < len(part):
                    n = 1
                    while i + n < len(part) and part[i: i + n + 1] in known and part[i: i + 1] in known:
                        n += 1
                    i, count = i + n, count + 1
            assert got[k] == count, (probe, known)


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 10
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, f"the cat sat number {i} on mats", "en", "x") for i in range(20)] + [(20 + i, f"der hund lief {i} weiter", "de", "x") for i in range(20)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !!", "de", "x"), (None, "the cat sat", None, "x"), (None, "the cat sat", None, "x")]
    got = language.identify(table(spark, rows + odd)).collect()
    assert len(got) == 45
    said = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert said[100] == said[101] == said[102] == ("und", 0.0)
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en", "en"]
    unlabelled = language.identify(table(spark, odd[:2] + [(1, "abc", None, "x")])).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language.identify(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("label", ["", " 12 !\n", "a", "th", "e a t o", "the cat"])
def test_little_labelled_text_wins_nothing(spark, label):
    random.seed(5)
    english, german = "the cat sat on mats while rain fell over old town".split(), "der hund lief weiter und das haus war alt am see".split()
    rows = [(i, " ".join(random.choices(w, k=60)), lang, "x") for lang, w in (("en", english), ("de", german)) for i in range(100 * (lang == "de"), 40 + 100 * (lang == "de"))]
    ids = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 5][:2]
    got = language.identify(table(spark, rows + [(i, label, "aa", "x") for i in ids])).collect()
    assert all(r.lang_pred == ("de" if r.doc_id >= 100 else "en") and r.score > 0.5 for r in got if r.doc_id < 1000)
    assert language.fit({"aa": label, "en": "the cat"})["languages"] == (["aa", "en"] if any(c.isalpha() for c in label) else ["en"])


def test_blank_rows_do_not_displace_labelled_text(spark):
    rows = [(i, " \n", "en", "x") for i in range(3000)] + [(3000 + i, f"the cat sat {i}", "en", "x") for i in range(10)]
    text = language.labelled_text(table(spark, rows), language.F.lit(True), 64, 32_000)["en"]
    assert text.count("the cat sat") == 10


def test_learnt_rows_have_equal_shares(spark):
    rows = [(i, chr(0x4E00 + i) * (100_000 if i % 2 else 400), "zh", "x") for i in range(40)]
    rows += [(7, "once " * 10, "en", "x")] * 5000 + [(7, f"copy {i} of an id", "en", "x") for i in range(3000)]
    texts = language.labelled_text(table(spark, rows), language.F.lit(True), 64, 32_000)
    counts = Counter(texts["zh"].replace(" ", ""))
    assert len(counts) == 40 and len(texts["zh"]) <= 32_000
    assert {counts[chr(0x4E00 + i)] for i in range(0, 40, 2)} == {400} and {counts[chr(0x4E00 + i)] for i in range(1, 40, 2)} == {(32_000 - 39 - 20 * 400) // 20}
    assert 30 < texts["en"].count("of an id") < 130 and texts["en"].count("once") in (0, 10)


def test_equal_shares_are_from_anywhere():
    assert language.equal_shares([(5, "abcdefghij"), (6, "xyz")], 8) == ["fghi", "xyz"]
    assert language.equal_shares([(0, "ab"), (1, "cd")], 100) == ["ab", "cd"]
    assert language.equal_shares([(9, "abcdefghij")], 4) == ["cdef"]


def test_costs_of_unseen_characters():
    model = language.fit({"aa": "ab", "en": "the cat sat on the mat " * 20})
    flat, roots = language.transition_table(model)
    points, rows = language.code_points(["ab ba", "the"])
    got = language.costs(language.symbol_table(model["letters"])[points].astype(np.int32), rows, model, flat, roots)
    heavy = np.log2(460)  # characters of the longer text
    # aa: ab, gap unseen, b, a, and one for the end; then t, h, e unseen
    parts = language.phrases(language.symbol_table(model["letters"])[points].astype(np.int32), rows, flat, roots)
    assert np.allclose(got[:, 0], parts[:, 0] * 6 + np.array([1, 3]) * (heavy - 6 + 6))
    assert np.allclose(got[:, 1], parts[:, 1] * heavy + np.array([2, 0]) * 6)


# ---------------------------------------------------------------- 6 packing

def check_packing(rows, texts, size=1024):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(np.array(ids[at: at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / sum(n for parts in sequences.values() for _, n in parts)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    assert check_packing(packing.pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.02
    small = table(spark, doc_rows(EDGES))
    assert check_packing(packing.pack_documents(small).collect(), dict(enumerate(EDGES))) < 0.02
    assert packing.pack_documents(small.limit(0)).count() == 0
    assert packing.pack_documents(table(spark, [(None, "a", "", ""), (None, "a", "", "")])).count() == 2


def test_column_generation_reaches_the_optimum():
    made = packing.patterns({384: 200, 640: 200, 256: 400, 1024: 3}, 1024)
    assert sum(n for _, n in made) == 303
    assert all(sum(k * c for k, c in p.items()) <= 1024 for p, _ in made)
    assert packing.patterns({}, 1024) == []


# ---------------------------------------------------------------- 7 repeated passages

def brute_repeats(texts, window):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s: s + window]), i)
    out = {}
    for i, t in texts.items():
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s: s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 9])
def test_repeats_brute_force(spark, window):
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(60)]
    passages = [random.choices(vocabulary, k=random.randint(window - 2, 2 * window)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(random.randint(1, 4)):
            t += random.choices(vocabulary, k=random.randint(0, 40)) + (random.choice(passages) if random.random() < .7 else [])
        texts.append("\n".join(t))
    texts += texts[:5] + EDGES + ["x " * (window - 1), "x " * (window - 1), "x " * 3 * window]
    texts = dict(enumerate(texts))
    docs = table(spark, [(i, t, "en", "x") for i, t in texts.items()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, window).collect()}
    want = brute_repeats(texts, window)
    assert got == want
    assert 10 < sum(r[1] > 0 for r in want.values()) < len(want)


def test_repeats_null_and_equal_ids(spark):
    long = " ".join(map(str, range(60)))
    docs = table(spark, [(None, long, "", ""), (1, long, "", ""), (1, long, "", ""), (2, long + " end", "", "")])
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 60), (None, 0)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8 URLs

def test_urls_fields_and_rules(spark):
    odd = ["https://WWW.Example.com/en/x?q#f", "http://example.com/en/", "http://a.example.com/en/1", "http://x.net/fr/2", "http://xnet/fr/",
           "http://net/es/", "no scheme", None, "", "http://host.com", "http://h.com?x/y", "x://y://z/", "http://A.ORG/p?a=1&b=2", "http://é.de/ü",
           "http://b.org/spam-9.html", "http://b.org/spam-9.html"]
    rows = [(i, u, "html") for i, u in enumerate(odd)] + [(None, f"http://s{i}.net/fr/{i}", "x") for i in range(8)]
    frame = table(spark, rows, "page_id long, url string, html string")
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

    def fields(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):]).group()

    def rule(host, path):
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        return max(fit, key=len, default=None)

    got = urls.judge(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path) == fields(r.url) and r.rule == rule(r.host, r.path)
        assert r.verdict == rules[r.rule] if r.rule else r.verdict in ("allow", "block") and 0 <= r.block_score <= 1
    assert {r.verdict for r in urls.judge(table(spark, [(1, "x", ""), (2, None, "")], "page_id long, url string, html string")).collect()} == {"allow"}
    assert urls.judge(frame.limit(0)).count() == 0


def test_urls_repeated_many_times_and_clashing_columns(spark):
    kind = "page_id long, url string, prediction double, features string, suffix int, known string, domain string, fold int, key0 int, n int"
    rows = [(i, ("http://a.com/", "http://b.net/fr/", "http://c.org/x")[i % 3], 1.0, "x", 1, "block", "y", 2, 3, 4) for i in range(3000)]
    got = urls.judge(table(spark, rows, kind), max_train=2).collect()
    assert Counter((r.url, r.rule) for r in got) == Counter({("http://a.com/", "com/"): 1000, ("http://b.net/fr/", "net/fr/"): 1000,
                                                            ("http://c.org/x", None): 1000})
    assert len({r.verdict for r in got if r.rule is None}) == 1


def test_urls_held_out(spark):
    rows = [(f"http://h{i % 50}.{'com' if i % 3 else 'net'}/{'x' if i % 3 else 'fr'}/{i}",) for i in range(400)]
    pages = spark.createDataFrame(rows, "url string")
    assert urls.held_out_auc(pages) > 0.95
    one = settle(urls.featured(pages, []).where("known = 'block'"))  # a verdict that only one suffix has: its own fold is not counted
    assert one.select("suffix_block").distinct().count() > 1
    assert urls.held_out_auc(pages.limit(0)) is None


# ---------------------------------------------------------------- 9 WARC

def test_warc_round_trip(spark, folder):
    big = "<p>a\r\n\r\nWARC/1.1 é</p>" * 100
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (4, "u\r\nWARC-Type: x", "short"), (6, "http://b", "short"), (7, "z", None), (8, "z", ""),
            (None, "n", big), (9, "d", big[:-1] + "x"), (9, "d", big[:-1] + "x")]
    frame = table(spark, [(*r, 1) for r in rows], "page_id long, url string, html string, extra int")
    captures = warc.with_types(frame)
    warc.write_warc(captures, folder + "/w", per_file=2)
    found = warc.assemble(warc.read_warc(spark, folder + "/w")).collect()
    assert len(found) == len(rows)
    assert all(r.request and r.metadata for r in found)
    assert all(bytes(r.response.payload).decode() == next(h or "" for p, u, h in rows if p == r.metadata.page_id)
               for r in found if r.response.record_type == "response" and r.metadata.page_id is not None)
    types = sorted(((r.metadata.page_id, r.response.record_type) for r in found), key=str)
    assert types == sorted([(1, "revisit"), (5, "response"), (3, "revisit"), (4, "response"), (6, "response"), (7, "response"), (8, "response"),
                            (None, "response"), (9, "response"), (9, "revisit")], key=str)
    five = next(r.response.record_id for r in found if r.metadata.page_id == 5)
    assert all(r.response.refers_to == five and r.response.payload_bytes == len(big.encode()) for r in found if r.metadata.page_id in (1, 3))
    warc.write_warc(warc.with_types(frame.limit(0)), folder + "/none")
    assert warc.read_warc(spark, folder + "/none").count() == 0


def test_warc_long_payloads_and_starts_within(spark, folder):
    """One archive; payloads that hold record starts, end in parts of one, or are longer than a batch of the text reader's buffer."""
    texts = ["\nWARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\n" * 50, "é" * 3_000_000, "\r\n\r\n\nWAR", "\nWARC/", "\n", "x"]
    frame = table(spark, list(enumerate(texts)), "page_id long, html string").selectExpr("*", "'u' AS url").coalesce(1)
    warc.write_warc(warc.with_types(frame), folder + "/w")
    found = warc.assemble(warc.read_warc(spark, folder + "/w")).collect()
    assert {r.metadata.page_id: bytes(r.response.payload).decode() for r in found} == dict(enumerate(texts))
    bare = warc.read_warc(spark, folder + "/w", payloads=False).where("record_type = 'response'").collect()
    assert sorted(r.payload_bytes for r in bare) == sorted(len(t.encode()) for t in texts) and not any(r.payload for r in bare)


def test_warc_of_other_programs(spark, folder):
    """A gzip member per record, names in any case, base 32 digests, continued lines, records of other types, no HTTP header."""
    import base64
    import gzip
    import os

    def record(kind, rid, block, *more):
        head = [b"WARC/1.0", b"warc-type:" + kind, b"WARC-RECORD-ID:   " + rid, *more, b"Content-length: %d" % len(block)]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"\xff\x00 not text \nWARC/1.0"
    digest = b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest())
    parts = [record(b"warcinfo", b"<i>", b"software: other\r\n"),
             record(b"response", b"<a>", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body, digest, b"WARC-Target-URI: http://a/\r\n b"),
             record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <a>"),
             record(b"metadata", b"<m>", b"fetchTimeMs: 5\r\n", b"WARC-Concurrent-To: <a>"),
             record(b"response", b"<dns>", b"20240101\r\na. 1 IN A"), record(b"revisit", b"<v>", b"", b"WARC-Refers-To: <a>", digest)]
    os.makedirs(folder + "/w")
    for name, data in (("a", parts), ("b", [])):
        with open(f"{folder}/w/{name}.warc.gz", "wb") as f:
            f.write(b"".join(data) or gzip.compress(b""))
    rows = {r.record_id: r for r in warc.read_warc(spark, folder + "/w").collect()}
    assert [rows[k].record_type for k in ("<i>", "<a>", "<q>", "<m>", "<dns>", "<v>")] == ["warcinfo", "response", "request", "metadata", "response", "revisit"]
    assert bytes(rows["<a>"].payload) == body and rows["<a>"].target == "http://a/ b"
    assert rows["<v>"].payload_digest == rows["<a>"].payload_digest == hashlib.sha1(body).hexdigest() and rows["<v>"].payload_bytes is None
    assert bytes(rows["<dns>"].payload) == b"20240101\r\na. 1 IN A" and rows["<m>"].page_id is None
    whole = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, folder + "/w")).collect()}
    assert set(whole) == {"<a>", "<dns>", "<v>"} and whole["<a>"].request and whole["<a>"].metadata and not whole["<dns>"].request
    plain = gzip.decompress(b"".join(parts))
    os.makedirs(folder + "/cut")
    with open(folder + "/cut/c.gz", "wb") as f:
        f.write(gzip.compress(plain[:plain.index(b"not text")]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, folder + "/cut").collect()


# ---------------------------------------------------------------- 10 fingerprints

def test_fingerprints_edit_and_order(spark):
    texts = near_copies(9, 10) + EDGES
    rows = doc_rows(texts) + [(None, "last of all", "en", "x"), (4, "a tie in doc 4", "en", "x")]
    got = fingerprints.edit_and_print(table(spark, rows)).collect()
    order = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (key, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        want.append((None if key == -(1 << 63) else key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 4:
            assert prints.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
        a, b = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == pytest.approx(1 - bin(a ^ b).count("1") / 128)
    assert fingerprints.edit_and_print(table(spark, rows).limit(0)).count() == 0


def test_simhash_votes():
    import pyarrow as pa

    text = "a b c d a b c e f " * 40
    _, _, _, first, hashes = fingerprints.text_words(pa.array([text]), lower=True)
    votes = np.zeros(128, int)
    for h in fingerprints.window_hashes(hashes[:, 0], 3):
        for lane in range(2):
            mixed = int(fingerprints.mix(np.array([h]) + np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) & (2 ** 64 - 1)))[0])
            votes[64 * lane: 64 * lane + 64] += [1 if mixed >> b & 1 else -1 for b in range(64)]
    want = [sum(1 << b for b in range(64) if votes[64 * lane + b] > 0) for lane in range(2)]
    assert fingerprints.simhash(pa.array([text]))[0].tolist() == want


@pytest.mark.parametrize("radius, blocks", [(3, 4), (3, 6), (0, 1), (5, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    random.seed(radius)
    base = [random.getrandbits(128) for _ in range(12)]
    prints = {b ^ sum(1 << k for k in random.sample(range(128), random.randint(0, 8))) for b in base for _ in range(8)}
    frame = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,), (f"{base[0]:032x}",)], "fingerprint string")
    prints.add(base[0])
    got = {(r["query"], r.found, r.distance) for r in fingerprints.within_radius(frame, frame, radius, blocks).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in prints for b in prints if bin(a ^ b).count("1") <= radius}


@pytest.mark.parametrize("radius, blocks, flips", [(16, 6, 2), (17, 6, 2), (4, 4, 1), (9, 7, 1)])
def test_turned_bits_find_all(spark, radius, blocks, flips):
    random.seed(radius)
    base = [random.getrandbits(128) for _ in range(5)]
    prints = {b ^ sum(1 << k for k in random.sample(range(128), random.randint(0, radius))) for b in base for _ in range(12)} | {0, 2 ** 128 - 1}
    frame = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    queries = frame.where("crc32(fingerprint) % 3 = 0").unionByName(frame.limit(3))
    asked = {int(r.fingerprint, 16) for r in queries.collect()}
    got = sorted((r["query"], r.found, r.distance) for r in fingerprints.within_radius(frame, queries, radius, blocks, flips).collect())
    assert got == sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in asked for b in prints if (a ^ b).bit_count() <= radius)


def test_op10_finds_near_copies_of_ordinary_length(spark, tmp_path):
    random.seed(10)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for d in range(20):
        text = random.choices(vocabulary, k=250)
        texts[100 * d], texts[100 * d + 2] = " ".join(text), " ".join(text)  # an exact copy
        text[random.randrange(250)] = "other"
        texts[100 * d + 1] = " ".join(text)
        texts[100 * d + 3] = " ".join(random.choices(vocabulary, k=250))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = fingerprints.op10_fingerprints(spark, str(tmp_path)).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.fingerprint, []).append(r.doc_id)
    value = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        if r.doc_id % 100:
            assert r.n_near is None and r.near is None
            continue
        found = sorted(d for x in r.near for d in ids[x.fingerprint])
        assert found == sorted(d for d in value if (value[d] ^ value[r.doc_id]).bit_count() <= 16) and r.n_near == len(found) - 1
        assert all(x.distance == (int(x.fingerprint, 16) ^ value[r.doc_id]).bit_count() for x in r.near)
        assert {r.doc_id, r.doc_id + 1, r.doc_id + 2} <= set(found)


def test_radius_needs_more_blocks(spark):
    with pytest.raises(ValueError):
        fingerprints.within_radius(spark.createDataFrame([], "fingerprint string"), spark.createDataFrame([], "fingerprint string"), 4, 4)
