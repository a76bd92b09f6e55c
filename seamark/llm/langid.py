"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
greedily into the longest phrases that occur in that language's text; the language
needing the fewest phrases a character wins. Each Python worker builds the automata
once from the broadcast sample and steps many texts at a time through flat
transition tables with NumPy; letters beyond the most frequent have sparse tables.
Long texts are parsed in pieces side by side. A piece's own parse and the one that comes
in from the piece before agree from the first phrase that both begin at the same place, so
that the sum is the parse of the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, lean, small_batches, steps

#: The sample: at most so many documents a language, cut to so many characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 48, 60_000
#: Codes of the dense tables: 0 is anything but a letter, the others are the most frequent letters.
DENSE = 64
#: Characters that are parsed side by side.
PIECE = 4096
#: Most cells of the grid that pieces are laid out in.
CELLS = 8_000_000
#: Bytes of text that one vectorised step takes.
STEP_BYTES = 4_000_000
_FAIL = np.int32(1 << 30)
#: Planes of Unicode that hold letters.
_CHARS = 0x40000


class Automaton:
    """Suffix automaton of codes as tables.

    Entry state * width + code of ``dense``: the next state where the phrase goes on; else the
    state after starting a new phrase with that code, plus _FAIL. The width is that of the alphabet, but
    DENSE at most; codes from there on are in ``keys`` (state * alphabet + code, sorted) and ``next``. From the last state, ``begin``, every code
    starts a phrase; a code that isn't in the text is a phrase of its own and leads there.
    """

    def __init__(self, codes: np.ndarray, alphabet: int):
        self.alphabet, self.width = alphabet, min(DENSE, alphabet)
        # Transitions are written where they stay; 0 is none, as nothing leads to the first state.
        table = np.zeros((2 * len(codes) + 2, self.width), np.int32)
        flat, width = memoryview(table.reshape(-1)), self.width
        rare: dict[int, dict[int, int]] = {}
        link, length, last = [-1], [0], 0

        def get(s: int, c: int) -> int:
            return flat[s * width + c] if c < width else rare.get(s, {}).get(c, 0)

        def put(s: int, c: int, to: int) -> None:
            if c < width:
                flat[s * width + c] = to
            else:
                rare.setdefault(s, {})[c] = to

        for c in codes.tolist():
            cur = len(link)
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and not get(p, c):
                put(p, c, cur)
                p = link[p]
            if p != -1:
                q = get(p, c)
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    table[clone] = table[q]
                    if q in rare:
                        rare[clone] = rare[q].copy()
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and get(p, c) == q:
                        put(p, c, clone)
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.begin = len(link)
        table = table[:self.begin + 1]
        np.copyto(table, np.where(table[0] > 0, table[0], np.int32(self.begin)) + _FAIL, where=table == 0)
        self.dense = table.reshape(-1)
        pairs = np.array(sorted((s * alphabet + c, t) for s, row in rare.items() for c, t in row.items()), np.int64).reshape(-1, 2)
        self.keys, self.next = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)

    def _rare(self, key: np.ndarray) -> np.ndarray:
        """Next state of each key, -1 if none."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def step(self, state: np.ndarray, code: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
        """The entries for states and codes; rare: where the code is DENSE or more."""
        if rare is None or not len(rare):
            at = state * np.int32(self.width)
            at += code
            return self.dense.take(at)
        v = self.dense.take(state * self.width + np.minimum(code, self.width - 1))
        c = code[rare].astype(np.int64)
        if len(self.keys):
            go, new = self._rare(state[rare] * np.int64(self.alphabet) + c), self._rare(c)
            v[rare] = np.where(go >= 0, go, np.where(new >= 0, new, self.begin) + _FAIL)
        else:
            v[rare] = self.begin + _FAIL
        return v

    def one(self, state: int, code: int) -> tuple[bool, int]:
        """Whether a phrase begins with the code, and the next state."""
        if code < self.width:
            v = int(self.dense[state * self.width + code])
        else:
            v = int(self.step(np.array([state], np.int32), np.array([code]), np.zeros(1, np.int64))[0])
        return v >= _FAIL, v & int(_FAIL - 1)


class Model:
    """Automata of all languages, built from {language: text}."""

    def __init__(self, texts: dict[str, str]):
        seen: dict[str, int] = {}
        for t in texts.values():
            for ch in t.lower():
                if ch.isalpha():
                    seen[ch] = seen.get(ch, 0) + 1
        known = sorted(seen, key=lambda c: (-seen[c], c))
        self.alphabet = len(known) + 2  # the last code: a letter of no training text
        kind = np.uint16 if self.alphabet < 1 << 16 else np.uint32
        self.lookup = np.zeros(0x110000, kind)
        self.lookup[:_CHARS] = [(self.alphabet - 1) * chr(i).isalpha() for i in range(_CHARS)]
        for i, c in enumerate(known):
            self.lookup[ord(c)] = i + 1
        self.langs = sorted(texts)
        self.tables = [Automaton(self.codes(texts[lang]), self.alphabet) for lang in self.langs]

    def codes(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text, runs of other characters than letters as one 0."""
        c = self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = c == 0
        return c[~(gap & np.concatenate([[True], gap[:-1]]))] if len(c) else c

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases by text (its codes) and language."""
        pieces, owner = [], []
        for i, c in enumerate(coded):
            for lo in range(0, len(c), PIECE):
                pieces.append(c[lo:lo + PIECE])
                owner.append(i)
        out = np.zeros((len(coded), len(self.langs)), np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        who = np.array(owner, np.int64)
        begins: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        lo = 0
        while lo < len(order):
            own = order[lo:lo + max(1, min(8192, CELLS // int(sizes[order[lo]])))]
            lo += len(own)
            n = sizes[own]
            grid = np.zeros((int(n[0]), len(own)), self.lookup.dtype)
            for k, j in enumerate(own):
                grid[: n[k], k] = pieces[j]
            active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")
            rare = [np.flatnonzero(row) for row in grid >= DENSE] if int(grid.max(initial=0)) >= DENSE else None
            # Pieces of texts of more than one: where their phrases begin is kept.
            parts = np.array([k for k, j in enumerate(own) if len(coded[who[j]]) > PIECE], np.int64)
            held = np.searchsorted(parts, active)  # how many of them are active, by step
            for li, table in enumerate(self.tables):
                at = np.full(len(own), table.begin, np.int32)
                count = np.zeros(len(own), np.int32)
                new = np.zeros((int(n[0]), len(parts)), bool) if len(parts) else None
                for step in range(int(n[0])):
                    m = int(active[step])
                    v = table.step(at[:m], grid[step, :m], None if rare is None else rare[step])
                    fail = v >> 30
                    count[:m] += fail
                    np.bitwise_and(v, _FAIL - 1, out=at[:m])
                    if new is not None:
                        w = held[step]
                        new[step, :w] = fail.take(parts[:w])
                single = np.ones(len(own), bool)
                single[parts] = False
                np.add.at(out[:, li], who[own[single]], count[single])
                for x, k in enumerate(parts):
                    begins[int(own[k]), li] = np.flatnonzero(new[: n[k], x]), int(at[k])
        if begins:
            self._stitch(pieces, who, begins, out)
        return out

    def _stitch(self, pieces, who, begins, out) -> None:
        """Adds the phrases of texts of several pieces: the parse that comes in goes on in a
        piece until it begins a phrase where the piece's own parse does."""
        states = [0] * len(self.tables)
        for j in sorted({j for j, _ in begins}):
            for li, table in enumerate(self.tables):
                own, end = begins[j, li]
                if j == 0 or who[j - 1] != who[j]:
                    out[who[j], li] += len(own)
                    state = end
                else:
                    state, n, met = states[li], 0, None
                    for x, c in enumerate(pieces[j]):
                        new, state = table.one(state, int(c))
                        if new:
                            n += 1
                            k = int(np.searchsorted(own, x))
                            if k < len(own) and own[k] == x:
                                met = x
                                break
                    out[who[j], li] += n
                    if met is not None:
                        out[who[j], li] += len(own) - int(np.searchsorted(own, met, "right"))
                        state = end
                states[li] = state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """und for null and letterless texts; else the language of fewest phrases
        (ties: first by name) and 1 - fewest / second fewest. Letters are what Unicode calls alphabetic."""
        coded = [self.codes(t) if t else np.zeros(0, self.lookup.dtype) for t in texts]
        own = [i for i, c in enumerate(coded) if c.any()]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if own and self.langs:
            n = self.phrases([coded[i] for i in own])
            best = np.argmin(n, axis=1)
            low = n[np.arange(len(own)), best]
            rest = n.copy()
            rest[np.arange(len(own)), best] = np.iinfo(np.int64).max
            second = rest.min(axis=1) if len(self.langs) > 1 else low
            for k, i in enumerate(own):
                lang[i] = self.langs[best[k]]
                score[i] = float(1 - low[k] / second[k]) if len(self.langs) > 1 else 1.0
        return lang, score


def held_out():
    """The documents that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """{language: training text}: whole documents in the order of a hash of their id.

    Each task keeps the first ids of each label before they are shuffled; then one scan
    fetches those documents' texts. Languages are few: the label set of the corpus.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    top = known.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n_docs)
    top = F.broadcast(top.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct())
    rows = (known.select("doc_id", "lang", "text").join(top, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
            .select("doc_id", "lang", F.substring("text", 1, n_chars).alias("text")).distinct().collect())
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(t)[:n_chars] for lang, t in out.items()}


def identify(docs: DataFrame, texts: dict[str, str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (0 to 1), or other names for these.

    Null, empty and letterless texts are und with score 0. Equal texts get equal results, repeated
    rows come again, an empty table gives none. With no labelled text at all everything is und. Texts
    are parsed whole, however long. Input columns of those names are replaced, others stay.
    """
    texts = sample(docs) if texts is None else texts
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    name = hash(tuple(sorted(texts.items())))
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            model = kept(name, lambda: Model(shared.value))
            lang, score = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    d = small_batches(docs.select(*keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + f", `{names[0]}` string, `{names[1]}` double"
    return d.mapInArrow(lambda batches: lean(run(batches), keep=True), schema)
