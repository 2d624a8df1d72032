"""Language identification by cross-parsing: the language whose labelled text parses a document into the fewest phrases.

For each language a suffix automaton is built over labelled text. A document is parsed from left to right into longest
matches with the automaton; the phrases, each weighing the logarithm of the language's text, per character are the
cross-parsing entropy, and the language with the least wins. A phrase weighs no less than a symbol spelt out, and a
character that the language's text lacks as much as the heaviest phrase and a symbol, in all languages alike: so little
text makes no language cheap. Automata are turned into transition tables in which a
failed match goes on from the root and counts one phrase, so that many stretches of text are parsed at once.

Texts are parsed whole, in stretches of ``STRETCH`` characters of their normalised form: letters lower-cased, all else a
gap; the letters that are most frequent in the labelled text have symbols of their own, the others share four.

Learned from: at most ``sample_rows`` (about) labelled rows a language, those with the smallest hash of their id and text, copies
counting once, and at most ``sample_chars`` characters of them. Each of the rows gives an equal share, or all it has if that is
less, from a place in its text that its hash decides. Memory is proportional to sample_chars times the number of languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in
alphabetical order; without labelled rows all is ``und``; languages whose labelled text has no letter are never predicted; with one language the score is 1; rows with null id are never
learned from; repeated rows get equal answers; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.llm.words import LETTER, char_classes, code_points, slices

STRETCH = 512
SYMBOLS = 64
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_text(docs: DataFrame, learn: Column, sample_rows: int, sample_chars: int) -> dict[str, str]:
    """Text per language for the automata; both bounds are per language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    digest = F.xxhash64(F.col("doc_id").cast("string"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(digest).alias("n")).collect()}  # one row per language
    if not counts:
        return {}
    rank = F.pmod(digest, F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, sample_rows / max(1, n)) * (1 << 30)))])
    begin = F.pmod(F.xxhash64(digest), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1
    piece = F.col("text").substr(begin.cast("int"), F.lit(sample_chars))
    chosen = rows.where(rank <= share[F.col("lang")]).select("lang", digest.alias("digest"), rank.alias("rank"), piece.alias("text"))
    texts: dict[str, list[tuple]] = {}
    for r in chosen.dropDuplicates(["lang", "digest"]).collect():
        texts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {lang: " ".join(equal_shares(sorted(found), sample_chars)) for lang, found in sorted(texts.items())}


def equal_shares(found: list[tuple[int, str]], sample_chars: int) -> list[str]:
    """As much of each (rank, text), alike for all that have it, as fits into ``sample_chars`` with gaps between."""
    left, most = sample_chars - (len(found) - 1), 0
    for n, size in enumerate(sorted(len(t) for _, t in found)):
        most = max(left, 0) // (len(found) - n)
        if size > most:
            break
        left, most = left - size, size
    starts = [rank % (max(len(t) - most, 0) + 1) for rank, t in found]
    return [t[a: a + most] for a, (_, t) in zip(starts, found)]


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions (state, symbol, target) of the suffix automaton, state 0 the root, and the number of states."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    state = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    symbol = np.fromiter((c for e in edges for c in e), np.uint8)
    target = np.fromiter((t for e in edges for t in e.values()), np.int32)
    return state.astype(np.int32), symbol, target, len(edges)


def fit(texts: dict[str, str]) -> dict:
    """The symbols of letters, and the automaton of each language that has any."""
    share: Counter = Counter()
    for text in texts.values():
        for c, n in Counter(x for x in text.lower() if x.isalpha() and len(x) == 1).items():
            share[c] += n / max(1, len(text))
    letters = [ord(c) for c, _ in sorted(share.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 5]]
    model = {"letters": letters, "languages": [], "automata": [], "sizes": []}
    table = symbol_table(letters)
    for lang, text in texts.items():
        points, _ = code_points([text])
        if not table[points].any():
            continue
        model["languages"].append(lang)
        model["automata"].append(suffix_automaton(table[points].tolist()))
        model["sizes"].append(len(text))
    return model


def symbol_table(letters: list[int]) -> np.ndarray:
    """Symbol of each code point: 0 a gap, 1-4 shared by rare letters, then the frequent letters."""
    kind = char_classes()
    points = np.arange(0x110000)
    lower = points.copy()
    cased = [c for c in np.flatnonzero(kind == LETTER).tolist() if len(chr(c).lower()) == 1]
    lower[cased] = [ord(chr(c).lower()) for c in cased]
    table = np.where(kind == LETTER, 1 + lower % 4, 0).astype(np.uint8)
    own = np.zeros(0x110000, np.uint8)
    own[letters] = np.arange(len(letters)) + 5
    return np.where((kind == LETTER) & (own[lower] > 0), own[lower], table)


def transition_table(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """All automata in one flat table, and the place of each root. An entry is twice the next place, plus one if a
    phrase ended."""
    parts, roots, at = [], [], 0
    for state, symbol, target, n in model["automata"]:
        lost = 2 * (at + n * SYMBOLS)  # the state after a character that the language's text does not hold
        table = np.full((n + 1, SYMBOLS), -1, np.int32)
        table[state, symbol] = 2 * (at + target.astype(np.int64) * SYMBOLS)
        again = np.where(table[0] >= 0, table[0], lost)  # begin a phrase with this character
        table[0] = again
        np.copyto(table, again[None, :] + 1, where=table < 0)
        parts.append(table.ravel())
        roots.append(at)
        at += (n + 1) * SYMBOLS
    return np.concatenate(parts), np.array(roots, np.int32)


def phrases(symbols: np.ndarray, rows: np.ndarray, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases of each text (the stretches of ``symbols`` between ``rows``) for each language."""
    count = -(-np.diff(rows) // STRETCH)
    owner = np.repeat(np.arange(len(count)), count)
    begin = rows[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
    length = np.minimum(STRETCH, rows[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    state = np.broadcast_to(roots, (len(order), len(roots))).copy()
    ended = np.zeros((len(order), len(roots)), np.int32)
    active = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # stretches longer than t
    for t in range(STRETCH):
        k = int(active[t])
        if not k:
            break
        found = table[state[:k] + symbols[begin[:k] + t][:, None]]
        ended[:k] += found & 1
        state[:k] = found >> 1
    out = np.zeros((len(count), len(roots)), np.int64)
    np.add.at(out, owner[order], ended + 1)
    return out


def costs(symbols: np.ndarray, rows: np.ndarray, model: dict, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Bits of each text for each language."""
    weight = np.log2(np.maximum(SYMBOLS, np.array(model["sizes"], float)))
    lacks = np.ones((SYMBOLS, len(roots)), np.int64)
    for i, (_, symbol, _, _) in enumerate(model["automata"]):
        lacks[symbol, i] = 0
    counts = np.array([np.bincount(symbols[a:b], minlength=SYMBOLS) for a, b in zip(rows[:-1], rows[1:])]).reshape(-1, SYMBOLS)
    return phrases(symbols, rows, table, roots) * weight + counts @ lacks * (weight.max() - weight + np.log2(SYMBOLS))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add lang_pred and score to all rows of ``docs``, whose first column is the text."""
    out_type = docs.select(*docs.columns[1:], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        table_of, classes = symbol_table(model["letters"]), char_classes()
        if model["languages"]:
            table, roots = transition_table(model)
        for part in slices(batches, part_column, 1 << 20):
            points, rows = code_points([t or "" for t in part.column(0).to_pylist()])
            letters = np.concatenate([[0], np.cumsum(classes[points] == LETTER)])
            has = np.diff(letters[rows]) > 0
            names, score = np.full(len(has), UNKNOWN, object), np.zeros(len(has))
            if model["languages"] and has.any():
                cost = costs(table_of[points].astype(np.int32), rows, model, table, roots)
                best = cost.argmin(axis=1)
                least = cost.min(axis=1)
                second = np.partition(cost, 1, axis=1)[:, 1] if len(roots) > 1 else np.full(len(has), np.inf)
                names[has] = np.array(model["languages"], object)[best[has]]
                share = np.ones(len(has)) if len(roots) == 1 else second / np.maximum(second + least, 1e-9)
                score[has] = share[has]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(names.tolist(), pa.string()), pa.array(score)],
                names=[*part.schema.names[1:], "lang_pred", "score"])

    part_column = docs.columns[0]
    return docs.mapInArrow(run, out_type)


def identify(docs: DataFrame, sample_rows: int = 64, sample_chars: int = 32_000) -> DataFrame:
    """(doc_id, text, lang) to (doc_id, held_out, lang_pred, score), learned from the rows that are not held out."""
    model = fit(labelled_text(docs, ~held_out(F.col("doc_id")), sample_rows, sample_chars))
    return predict(docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out")), model)


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
