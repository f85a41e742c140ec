"""Language identification by cross-parsing entropy.

For each language, the suffix automaton of labelled text recognises every substring of that text. A document is parsed greedily
into the longest phrases that a language's text holds; the more phrases it takes, the less the two are alike. A phrase costs log2(N)
bits, where N is the length of the longest reference, in every language; a character that a reference lacks is a phrase and costs
log2 of the alphabet besides. So a short or empty reference is never cheaper than a full one. The language of least cost wins.

The automata are compiled into tables of transitions, and many texts step through them side by side.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, seed_of

#: Bounds of the fit: characters of a language's reference, and of a passage. References are made of passages from all over the labelled
#: texts, drawn by hash, DRAWN times as many in expectation as a reference takes.
REFERENCE_CHARS, PASSAGE_CHARS, DRAWN = 20_000, 500, 3
#: Letters of a language whose transitions stand in a dense table, its most frequent ones; those of its other letters stand in a sorted list.
LETTERS = 62
#: Texts are parsed in runs of this many characters, so that long texts step side by side too; then runs that began amid a phrase are put right.
RUN = 2048
BATCH_CHARS = 4_000_000
UNKNOWN = "und"

#: What an entry of a table holds above the state: one for a phrase that begins, and _LITERAL for a character that the reference lacks.
#: A state takes _STATE bits (an automaton has at most two for each character of its reference), and a run's sum of these stays in 32 bits.
_STATE, _LITERAL = 17, 1 << 12
_STATES = (1 << _STATE) - 1
_ALPHA: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _ALPHA[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Table:
    """The automaton of one language.

    of gives the language's own code of each code of a text: 0 for what its reference lacks, below width for the dense letters.
    dense[s * width + code] is the state that follows s, with what it counts from bit _STATE on; a run starts in the last state.
    Of rarer letters, keys holds s * len(of) + code in order, and to the states that follow; where there is none, the next phrase
    begins in fresh[code].
    """

    of: np.ndarray
    width: int
    dense: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    fresh: np.ndarray

    @property
    def void(self) -> int:
        return len(self.dense) // self.width - 1

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        code = self.of[code]
        if not len(self.keys):
            return self.dense[state * np.int32(self.width) + code]
        rare = np.flatnonzero(code >= self.width)
        letter = code[rare]
        code[rare] = 0
        out = self.dense[state * np.int32(self.width) + code]
        key = state[rare].astype(np.int64) * len(self.of) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[rare] = np.where(self.keys[at] == key, self.to[at], self.fresh[letter])
        return out


@dataclass
class Languages:
    """names in order, and a table of each. A phrase costs `bits`, a literal `literal_bits` besides; code_of numbers all letters of any reference."""

    names: list[str]
    tables: list[Table]
    bits: float
    literal_bits: float
    code_of: np.ndarray

    def codes(self, text: str) -> np.ndarray:
        """A text's letters in lower case, other runs as one space (code 1), letters that no reference holds as 0."""
        chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = self.code_of[chars]
        space = code == 1
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1])
        return code[keep]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text takes in each language."""
        return self.counts(texts)[0]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each text takes in each language, and how many of them are characters that the reference lacks."""
        coded = [self.codes(t) for t in texts]
        owner, parts = [], []
        for i, c in enumerate(coded):
            for at in range(0, len(c), RUN):
                owner.append(i)
                parts.append(c[at : at + RUN])
        phrases, literals = np.zeros((2, len(texts), len(self.names)), dtype=np.int64)
        if not parts:
            return phrases, literals
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        size, owner_of = size[order], np.array(owner)[order]
        # character `step` of run k stands at base[step] + k, so that the runs which are that long lie side by side
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        base = np.cumsum(active) - active
        grid = np.empty(int(size.sum()), dtype=np.int32)
        for k, i in enumerate(order):
            grid[base[: len(parts[i])] + k] = parts[i]
        place = np.empty(len(parts), dtype=np.int64)
        place[order] = np.arange(len(parts))
        follows = np.full(len(parts), -1)
        goes_on = np.flatnonzero(np.diff(owner) == 0)
        follows[place[goes_on]] = place[goes_on + 1]
        for lang, table in enumerate(self.tables):
            trace = np.empty_like(grid)
            state = np.full(len(parts), table.void, dtype=np.int32)
            count = np.zeros(len(parts), dtype=np.int32)
            for at, n in zip(base, active, strict=True):
                to = trace[at : at + n] = table.step(state[:n], grid[at : at + n])
                count[:n] += to >> _STATE
                state[:n] = to & _STATES
            _mend(table, trace, grid, base, size, state, follows, count)
            phrases[:, lang] = np.bincount(owner_of, count % _LITERAL, len(texts)).astype(np.int64)
            literals[:, lang] = np.bincount(owner_of, count // _LITERAL, len(texts)).astype(np.int64)
        return phrases, literals

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score (0 to 1, how much cheaper it is than the next) for each text."""
        letter = is_letter()
        able = [bool(t) and bool(letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")].any()) for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at, upto = [i for i, a in enumerate(able) if a], 0
        while at and self.names and upto < len(at):
            some, chars = [], 0
            while upto < len(at) and chars < BATCH_CHARS:
                some.append(at[upto])
                chars += len(texts[at[upto]])
                upto += 1
            phrases, literals = self.counts([texts[i] for i in some])
            cost = phrases * self.bits + literals * self.literal_bits
            best = cost.argmin(1)
            ranked = np.sort(cost, 1)
            second = ranked[:, 1] if cost.shape[1] > 1 else np.full(len(some), np.inf)
            for i, b, low, high in zip(some, best, ranked[:, 0], second, strict=True):
                names[i] = self.names[b]
                scores[i] = 1.0 if np.isinf(high) else 1 - low / max(high, 1e-9)
        return names, scores


def _mend(table: Table, trace: np.ndarray, grid: np.ndarray, base: np.ndarray, size: np.ndarray, state: np.ndarray, follows: np.ndarray, count: np.ndarray) -> None:
    """Carry the state at the end of each run into the run that follows (-1: none), and put trace and count right, until every run goes on from the one before.

    A run is parsed again only as far as it differs, as a rule until the phrase it began in has ended. A run that differs to its
    end changes the one after it, so the worst case is that of parsing each text in one piece.
    """
    at = np.flatnonzero(follows >= 0)
    todo, now = follows[at], state[at]
    while len(todo):
        run, step, changed, ended = todo, 0, [], []
        while len(run):
            cell = base[step] + run
            to, had = table.step(now, grid[cell]), trace[cell]
            trace[cell] = to
            count[run] += (to >> _STATE) - (had >> _STATE)
            now = to & _STATES
            step += 1
            differs = now != (had & _STATES)
            over = differs & (size[run] == step) & (follows[run] >= 0)
            changed.append(follows[run[over]])
            ended.append(now[over])
            on = differs & (size[run] > step)
            run, now = run[on], now[on]
        todo, now = np.concatenate(changed), np.concatenate(ended)


def build(samples: dict[str, list[str]]) -> Languages:
    """Compile the automata of each language's texts, up to REFERENCE_CHARS characters of them."""
    names = sorted(samples)
    letter = is_letter()
    spaced = {n: " ".join("".join(c if letter[ord(c)] else " " for c in " ".join(samples[n]).lower()).split())[:REFERENCE_CHARS] for n in names}
    known = sorted(set("".join(spaced.values())) - {" "})
    code_of = np.ones(0x110000, dtype=np.int32)
    code_of[letter] = 0
    for k, c in enumerate(known):
        code_of[ord(c)] = k + 2
    longest = max(map(len, spaced.values()), default=0)
    tables = [compiled([int(code_of[ord(c)]) for c in spaced[n]], len(known) + 2) for n in names]
    return Languages(names, tables, float(np.log2(max(longest, 2))), float(np.log2(len(known) + 2)), code_of)


def compiled(codes: list[int], n_codes: int) -> Table:
    """The table of a reference, with all of its letters, from its codes below n_codes."""
    often = Counter(c for c in codes if c != 1)
    own = {1: 1} | {c: k for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c)), 2)}
    of = np.array([own.get(c, 0) for c in range(n_codes)], dtype=np.int32)
    nxt = suffix_automaton([own[c] for c in codes])
    width = min(len(often), LETTERS) + 2
    # one more state, in which a run starts and to which characters lead that the reference lacks: whatever follows begins a phrase
    void = len(nxt)
    fresh = np.full(len(often) + 2, void | (1 + _LITERAL) << _STATE, dtype=np.int32)
    for c, t in nxt[0].items():
        fresh[c] = t | 1 << _STATE
    dense = np.empty((void + 1, width), dtype=np.int32)
    dense[:] = fresh[:width]  # where no transition leads on, the next phrase begins with this very character
    rare = {}
    for s, to in enumerate(nxt):
        for c, t in to.items():
            if c < width:
                dense[s, c] = t
            else:
                rare[s * n_codes + c] = t
    keys = np.array(sorted(rare), dtype=np.int64)
    return Table(of, width, dense.ravel(), keys, np.array([rare[int(k)] for k in keys], dtype=np.int32), fresh)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Build the automata from documents that have a language and aren't held out.

    Labelled texts are cut into passages of PASSAGE_CHARS characters, whole texts without exception. Of each language, the passages
    are drawn whose hash (of id and number) falls under a share of its own count, so that the sample is a bounded one of all labelled
    text and doesn't depend on order or partitioning. Fewer passages give a shorter reference. A language that occurs but
    has no word in its sample still takes part, with an empty reference, which no text with a letter of another one falls to.
    """
    n = F.ceil(F.length("text") / PASSAGE_CHARS).cast("int")
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col(id_col), 4, 2)
    ).withColumn("n", n)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return build({})
    # one row per language: as many as the corpus has, whatever its size; each language's table takes up to 10 MB in a Python worker
    wanted = DRAWN * REFERENCE_CHARS / PASSAGE_CHARS
    share = docs.sparkSession.createDataFrame([(k, min(1.0, wanted / max(n, 1))) for k, n in counts.items()], "lang string, share double")
    place = lambda k: F.pmod(F.xxhash64(F.lit("language"), F.coalesce(F.col("id").cast("string"), F.lit("")), k), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: place(k) < F.col("share"))
    passages = F.transform(drawn, lambda k: F.substring("text", k * PASSAGE_CHARS + 1, F.lit(PASSAGE_CHARS)))
    some = known.filter("n > 0").join(F.broadcast(share), "lang")
    got = some.select("lang", F.explode(passages).alias("text")).collect()
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(got, key=lambda r: (r["lang"], seed_of("language", r["text"]), r["text"])):
        samples[r["lang"]].append(r["text"])
    return build(samples)


def identify(docs: DataFrame, languages: Languages, keep: list | None = None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, then lang_pred and score (or the given names), for every row; the whole text is parsed.

    Null texts, and those without any letter, are `und` with score 0. Ties go to the language that sorts first. Letters that
    no reference holds cost a phrase each, in every language. Repeated rows get equal answers. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        languages = shared.value

        def run(texts: list[str | None]) -> dict:
            found, scores = languages.predict(texts)
            return {names[0]: pa.array(found, type=pa.string()), names[1]: scores}

        return run

    return map_texts(docs, keep if keep is not None else [F.col("doc_id")], F.col(text_col), make, f"`{names[0]}` string, `{names[1]}` double")


def language(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out (never in a reference), lang_pred and score of every document."""
    return identify(docs, fit(docs, id_col), [F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 4, 2).alias("held_out")])
