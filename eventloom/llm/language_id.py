"""Language identification by cross-parsing with suffix automata.

Per language a suffix automaton of labelled text is built; a text is parsed from
left to right into the longest phrases that the automaton knows.  The language
that needs the fewest phrases, in bits per character, wins (cross-parsing entropy).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the labelled sample: texts per language, characters per language in its automaton, and characters in all automata (at most 272 bytes each, so 49 MB in all).
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 24_000
MODEL_CHARS = 180_000
#: Characters parsed in step.
STRETCH = 256
_ALPHABET = 64
_FOREIGN = _ALPHABET - 1

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, ``_FOREIGN`` if it is a letter and 0 if not."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((_FOREIGN if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint8, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Code points of a text's letters; each run of others is left as its first one."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cps] > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return cps[keep]


def alphabet(texts: list[str]) -> str:
    """The most frequent letters of a language's sample, as many as have symbols of their own."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    return "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: _FOREIGN - 1])


def fold(letters: str) -> np.ndarray:
    """Code point to symbol: 0 ends a word, then the letters of the alphabet in either case; all others are ``_FOREIGN``."""
    table = _letters().copy()
    for i, c in enumerate(letters):
        for form in (c, c.upper()):
            if len(form) == 1:
                table[ord(form)] = i + 1
    return table


class Table:
    """Transitions of a suffix automaton, a row per state, and the symbols with which a phrase goes on from a state, as bits.

    Where no phrase goes on, the transition is to the state that the symbol alone leads to.
    """

    def __init__(self, moves: np.ndarray, known: np.ndarray):
        self.moves, self.known = moves, known

    def __len__(self) -> int:
        return len(self.known)

    def __getitem__(self, at: tuple[int, int]) -> int:
        """The state that a symbol leads to; ``~state`` where a phrase ends before it."""
        to = int(self.moves[at])
        return to if int(self.known[at[0]]) >> int(at[1]) & 1 else ~to


def automaton(sample: np.ndarray) -> Table:
    """The suffix automaton of ``sample``."""
    links, lengths, moves = [-1], [0], [{}]
    last = 0
    for c in sample.tolist():
        cur = len(moves)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                copy = len(moves)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = links[p]
                links[q] = links[cur] = copy
        last = cur
    start = np.zeros(_ALPHABET, np.uint16 if len(moves) <= 1 << 16 else np.uint32)
    for c, q in moves[0].items():
        start[c] = q
    table = np.repeat(start[None, :], len(moves), 0)
    known = np.zeros(len(moves), np.uint64)
    for s, m in enumerate(moves):
        if m:
            table[s, list(m)] = list(m.values())
            known[s] = sum(1 << c for c in m)
    return Table(table, known)


def cuts(table: Table, steps: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many phrases begin in each stretch, apart from the one that begins with a text.

    ``steps[i]`` has the i-th symbol of all stretches, longest stretches first;
    ``before`` is the number of the stretch that the text had before, or -1.  All
    stretches are first parsed in step as if a phrase began with each.  Then those that
    follow another are parsed again from the state in which that one ended, until they
    reach a state that they had before; from there on both parses are the same.  This goes on while an end
    changes, so phrases run on over the ends of stretches as in a parse of the whole text.
    """
    flat, known, one = table.moves.reshape(-1), table.known, np.uint64(1)
    height, width = steps.shape
    states = np.zeros((height, width), np.int32)
    begun = np.zeros((height, width), bool)
    state = np.zeros(width, np.int32)
    active = np.searchsorted(-sizes, -np.arange(height), side="left")
    for i, n in enumerate(active.tolist()):
        now, symbol = state[:n], steps[i, :n]
        begun[i, :n] = (known[now] >> symbol.view(np.uint32)) & one == 0
        state[:n] = flat[(now << 6) | symbol]
        states[i, :n] = state[:n]
    after = np.full(width, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    at = np.flatnonzero(before >= 0)
    at = at[states[sizes[before[at]] - 1, before[at]] != 0]
    while len(at):
        now = states[sizes[before[at]] - 1, before[at]]
        changed = []
        for i in range(height):
            symbol = steps[i, at]
            begun[i, at] = (known[now] >> symbol.view(np.uint32)) & one == 0
            now = flat[(now << 6) | symbol].astype(np.int32)
            apart = states[i, at] != now
            states[i, at] = now
            ended = apart & (sizes[at] == i + 1)
            changed.append(at[ended])
            apart &= ~ended
            at, now = at[apart], now[apart]
            if not len(at):
                break
        at = after[np.concatenate(changed)] if changed else at
        at = at[at >= 0]
    return begun.sum(0)


class Model:
    """Automata of the learned languages, in the order of their names, and the letters that each knows."""

    def __init__(self, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS, model_chars: int = MODEL_CHARS):
        self.langs = sorted(samples)
        self.letters, self.tables, self.bits = [], [], []
        chars = min(chars, max(1, model_chars // max(1, len(samples))))
        for lang in self.langs:
            letters = alphabet(samples[lang])
            got = fold(letters)[code_points("\n".join(samples[lang]))][:chars]
            self.letters.append(letters)
            self.tables.append(automaton(got))
            self.bits.append(np.log2(max(2, len(got))))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [code_points(t) for t in texts]
        sizes = np.fromiter((len(c) if _letters()[c].any() else 0 for c in coded), np.int64, len(coded))
        if not self.langs or not sizes.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(coded)), parts)
        first = np.cumsum(parts) - parts
        nth = np.arange(len(owner)) - first[owner]
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, place[np.arange(len(owner)) - 1], -1)[order]
        owner, nth, length = owner[order], nth[order], length[order]
        every = np.concatenate([*(c for c, n in zip(coded, sizes, strict=True) if n), np.zeros(STRETCH, np.uint32)])
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
        where = begin[None, :] + np.arange(int(length.max()))[:, None]
        cost = []
        for table, letters, bits in zip(self.tables, self.letters, self.bits, strict=True):
            steps = fold(letters)[every][where].astype(np.int32)
            cost.append(bits * ((sizes > 0) + np.bincount(owner, cuts(table, steps, length, before), len(coded))))
        cost = np.stack(cost)
        best = cost.argmin(0)
        low = cost.min(0)
        rest = np.where(np.arange(len(cost))[:, None] == best[None, :], np.inf, cost).min(0) if len(cost) > 1 else np.full(len(coded), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isfinite(rest) & (rest > 0), 1 - low / rest, 1.0)
        return (
            [self.langs[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist(), strict=True)],
            [float(s) if n else 0.0 for s, n in zip(score.tolist(), sizes.tolist(), strict=True)],
        )


def fit(docs: DataFrame, may_learn: Column, *, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Automata from a bounded sample of the labelled rows of ``docs(doc_id, text, lang)``.

    ``sample_texts`` hash slots per language hold one text each, chosen from the
    columns doc_id and lang alone; ``sample_chars`` bounds each automaton.  Only
    the sample's texts reach the driver, and ``MODEL_CHARS`` bounds all automata together: with
    more than MODEL_CHARS / sample_chars languages (seven) each gets less.  Rows without text, lang or doc_id are
    not learned from; a language whose sample has no letters is dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(may_learn & F.col("lang").isNotNull())
    order = F.xxhash64("doc_id")
    picked = rows.groupBy("lang", F.pmod(order, F.lit(sample_texts)).alias("slot")).agg(F.min(F.struct(order.alias("h"), "doc_id")).alias("m")).select("m.doc_id").collect()
    ids = [r.doc_id for r in picked if r.doc_id is not None]
    samples: dict[str, list[tuple[int, str]]] = {}
    if ids:
        for r in rows.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", F.substring("text", 1, sample_chars).alias("text")).where("text is not null").collect():
            samples.setdefault(r.lang, []).append((r.doc_id, r.text))
    # An equal share of the automaton for each text, so that one long text does not fill it.
    share = {lang: max(200, 2 * sample_chars // len(got)) for lang, got in samples.items()}
    texts = {lang: [t[: share[lang]] for _, t in sorted(got)] for lang, got in samples.items()}
    return Model({k: v for k, v in texts.items() if any(_letters()[code_points(t)].any() for t in v)}, sample_chars)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and ``lang_pred`` and ``score``, with underscores behind where ``docs`` has such names; see ``predict``.

    Rows pass through the parser in batches with their other columns, so nothing is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = next(c for c in docs.columns if c.lower() == "text")
    new = [common.fresh(docs, "lang_pred"), common.fresh(docs, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predicted(shared.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], names=[*batch.schema.names, *new])

    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _predicted(known: Model, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    langs, scores, at, total = [], [], 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > 1_000_000 or i == len(texts) - 1:
            a, b = known.predict([x or "" for x in texts[at : i + 1]])
            langs += a
            scores += b
            at, total = i + 1, 0
    return pa.array(langs, pa.string()), pa.array(scores, pa.float64())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    The whole text is parsed.  ``und`` and 0 where the text is null, empty or has
    no letter; equal costs go to the language whose name sorts first.  The score is one minus
    the ratio of the best language's bits to the next one's.  Repeated rows and
    null ids stay as they are; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_predicted(shared.value, batch["text"].to_pylist())], names=["doc_id", "lang_pred", "score"])

    return common.identified(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
