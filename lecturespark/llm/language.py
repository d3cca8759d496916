"""Language identification of mixed text: scripts, word scores, and a Viterbi path over the words.

Counts of hashed letter n-grams per language come from all training documents. The
script of a word narrows the languages; a path over the words with a price for every
switch then labels spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import mixed, slices, word_codes

BINS, GRAMS = 1 << 15, (1, 2, 3, 4)
SWITCH = 12.0  # price of a change of language, in nats
NARROWED = -60.0  # score of a language that does not use a word's script
SCRIPT_SHARE = 0.01  # a language uses a script that has this share of its letters
ERRORS = 3.0  # standard errors that a text may fit worse than its floor, so that short texts stay
LABELLED = 0.5  # share of the letters that must be in scripts of learned languages
SLICE_SCORES = 24_000_000  # characters times languages that one step holds

# First code points of letter ranges and their scripts; ranges end where the next one starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words' letters in lower case, first position of each word)."""
    plain = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{M}]+", ""))
    plain = pc.if_else(pc.match_substring_regex(plain, r"\p{L}"), plain, "")  # marks alone are no letters
    sizes = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def _grams(points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, words): the hashed n-grams of each word, with a mark before and after its letters."""
    sizes = np.diff(firsts)
    used = np.flatnonzero(sizes)
    marked = np.zeros(len(points) + 2 * len(used), np.uint64)
    starts = firsts[used] + 2 * np.arange(len(used))
    lengths = sizes[used] + 2
    owner = np.repeat(np.arange(len(used)), lengths)
    inner = np.ones(len(marked), bool)
    inner[starts] = inner[starts + lengths - 1] = False
    marked[inner] = points
    ends = (starts + lengths)[owner] if len(used) else starts
    bins, words, value = [], [], np.zeros(len(marked), np.uint64)
    at = np.arange(len(marked))
    for n in range(1, max(GRAMS) + 1):
        inside = at + n <= ends
        value = mixed(value[inside[:len(value)]] * np.uint64(0x9E3779B97F4A7C15) + marked[at[inside] + n - 1] + np.uint64(1))
        at, ends, owner = at[inside], ends[inside], owner[inside]
        if n in GRAMS:
            bins.append((value % np.uint64(BINS)).astype(np.int64))
            words.append(used[owner])
    return np.concatenate(bins), np.concatenate(words)


def _word_scripts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The script of each word's first letter; -1 without letters."""
    scripts = np.full(len(firsts) - 1, -1)
    some = np.flatnonzero(np.diff(firsts))
    scripts[some] = SCRIPT_OF[np.searchsorted(STARTS, points[firsts[some]], side="right") - 1]
    return scripts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # by code point
    scores: np.ndarray  # BINS x languages, log probabilities
    uses: np.ndarray  # scripts x languages, whether a language is a candidate
    learned: np.ndarray  # whether any language uses a script
    floors: np.ndarray  # per language, the least log probability per n-gram of its own texts
    spreads: np.ndarray  # per language, the standard deviation of that of one n-gram


def _floors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floors, spreads) from the counts of all labelled texts.

    The floor lies half-way between what an n-gram of the language's own texts has on
    average and what one of the other languages' texts has under its model; and at least an
    eighth of the way to a bin drawn at random, for languages that are alone or alike.
    """
    chance = grams / grams.sum(axis=0)
    logs = np.log(chance)
    cross = logs.T @ chance  # [model, texts]
    own, n = np.diag(cross), len(cross)
    others = (cross.sum(axis=1) - own) / (n - 1) if n > 1 else own
    spreads = np.sqrt(np.maximum((chance * logs ** 2).sum(axis=0) - own ** 2, 0))
    return own - np.maximum((own - others) / 2, (own - logs.mean(axis=0)) / 8), spreads


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows with a text and a language; no row is sampled.

    Every task counts into one table of ``BINS`` per language and the sums reach the
    driver, so the model is bounded by the number of languages. Without training rows
    it has no language.
    """

    def counted(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, 0):
                offsets, codes, words = word_codes(batch.column(0))
                points, firsts = _letters(words)
                bins, owners = _grams(points, firsts)
                scripts, letters = _word_scripts(points, firsts), np.diff(firsts)
                per_row = batch.column(1).to_pylist()
                row_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                names = np.array(per_row, object)
                for name in dict.fromkeys(per_row):
                    times = np.bincount(codes[(names == name)[row_of]], minlength=len(words))
                    total = sums.setdefault(name, np.zeros(BINS + len(NAMES)))
                    total[:BINS] += np.bincount(bins, times[owners], BINS)
                    some = scripts >= 0
                    total[BINS:] += np.bincount(scripts[some], (times * letters)[some], len(NAMES))
        for name, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(total[full].astype(np.int64))],
                                             ["lang", "bin", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    sums = np.zeros((BINS + len(NAMES), len(languages)))
    if languages:
        sums[counts["bin"].to_numpy(), np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object))] = counts["n"].to_numpy()
    grams, letters = sums[:BINS] + 0.5, sums[BINS:]
    scores = np.log(grams / grams.sum(axis=0)) / len(GRAMS)  # n-grams of several lengths tell of the same letters
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    learned = uses.any(axis=1)
    uses[~learned] = True  # a script that no language uses tells nothing
    return LanguageModel(languages, scores.astype(np.float32), uses, learned, *_floors(grams))


def _word_scores(model: LanguageModel, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words x languages, letters per word)."""
    points, firsts = _letters(words)
    bins, owners = _grams(points, firsts)
    scores = np.stack([np.bincount(owners, column[bins], len(words)) for column in model.scores.T], axis=1) if len(bins) else np.zeros((len(words), len(model.languages)))
    scripts = _word_scripts(points, firsts)
    some = scripts >= 0
    scores[some] += np.where(model.uses[scripts[some]], 0, NARROWED)
    return scores.astype(np.float32), np.diff(firsts)


def best_paths(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of every word: rows ``offsets[i]:offsets[i + 1]`` of ``scores`` are one document.

    All documents take their n-th step together. A state follows itself or, at a price, the
    best state before it; ties go to the lower state.
    """
    states = np.zeros(len(scores), np.int16)
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    starts, counts = offsets[:-1][order], counts[order]
    alive = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), side="right")
    if len(alive) == 0:
        return states
    leaps, tops = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    value = scores[starts[:alive[0]]]
    lasts = np.zeros(len(counts), np.int16)
    for t in range(1, len(alive)):
        k, ended = alive[t], alive[t - 1]
        if k < ended:
            lasts[k:ended] = value[k:].argmax(axis=1)
            value = value[:k]
        at = starts[:k] + t
        top = value.argmax(axis=1)
        entry = value[np.arange(k), top][:, None] - np.float32(switch)
        leap = entry > value
        leaps[at], tops[at] = leap, top
        value = np.where(leap, entry, value) + scores[at]
    lasts[:alive[-1]] = value.argmax(axis=1)
    state = lasts
    for t in range(len(alive) - 1, 0, -1):
        k = alive[t]
        at, now = starts[:k] + t, state[:k]
        states[at] = now
        state[:k] = np.where(leaps[at, now], tops[at], now)
    states[starts[:alive[0]]] = state[:alive[0]]
    return states


def _labelled(model: LanguageModel, texts: pa.Array):
    """(offsets, state per word, letters per word)."""
    offsets, codes, words = word_codes(texts)
    scores, letters = _word_scores(model, words)
    return offsets, best_paths(scores[codes], offsets), letters[codes]


def _steps(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from slices(whole, 1, SLICE_SCORES // max(4, len(model.languages)))


def _predictions(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of most letters of each text, and its share; ``und`` and 0 without letters or languages."""
    rows, n_lang = len(texts), len(model.languages)
    if n_lang == 0:
        return ["und"] * rows, np.zeros(rows)
    offsets, states, letters = _labelled(model, texts)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    sums = np.bincount(row_of * n_lang + states, letters, rows * n_lang).reshape(-1, n_lang)
    total, best = sums.sum(axis=1), sums.argmax(axis=1)
    return ([model.languages[b] if t > 0 else "und" for b, t in zip(best, total)],
            np.where(total > 0, sums.max(axis=1, initial=0) / np.maximum(total, 1), 0.0))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row: the language of most letters, and its share of the letters.

    ``und`` with score 0 for a null text, one without letters, and a model without
    languages. Ties go to the first language by code point. Repeated rows give
    repeated rows and null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches):
        for batch in _steps(batches, shared.value):
            names, share = _predictions(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(labelled, f"`{id_col}` {kind}, lang_pred string, score double")


def _fits(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of most letters and its share as ``_predictions``, and whether the text fits its path.

    Words in scripts that no learned language uses have no language. The rest must have, per
    n-gram, the log probability of its languages' floors, less the error that its length allows.
    """
    rows, n_lang = len(texts), len(model.languages)
    offsets, codes, words = word_codes(texts)
    scores, letters = _word_scores(model, words)
    states = best_paths(scores[codes], offsets)
    scripts = _word_scripts(*_letters(words))
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.bincount(row_of, letters[codes], rows)
    own = np.where((scripts >= 0) & model.learned[scripts], letters, 0)[codes]
    sums = np.bincount(row_of * n_lang + states, own, rows * n_lang).reshape(-1, n_lang)
    grams = np.where(own > 0, len(GRAMS) * own + 2, 0)  # the n-grams of a word with its two marks
    fit = np.bincount(row_of, np.where(own > 0, scores[codes, states] * len(GRAMS), 0) - grams * model.floors[states], rows)
    # N-grams of several lengths tell of the same letters, so a letter counts as one draw.
    n = np.maximum(sums.sum(axis=1), 1)
    spread = (sums @ model.spreads) / n
    fits = fit / np.maximum(np.bincount(row_of, grams, rows), 1) >= -ERRORS * spread / np.sqrt(n)
    best = sums.argmax(axis=1)
    return ([model.languages[b] if t > 0 else "und" for b, t in zip(best, sums.sum(axis=1))],
            np.where(total > 0, sums.max(axis=1, initial=0) / np.maximum(total, 1), 0.0), fits & (sums.sum(axis=1) >= LABELLED * total))


def _has_letters(texts: pa.Array) -> np.ndarray:
    offsets, codes, words = word_codes(texts)
    letters = np.diff(_letters(words)[1])[codes]
    return np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)), letters, len(texts)) > 0


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", min_share: float = 0.0,
                  fitting: bool = False) -> DataFrame:
    """The documents with letters whose main language has ``min_share`` of them; a null language becomes the main one.

    With ``fitting``, texts that fit no learned language, nor a mixture of them, go as well. Without a
    learned language nothing can be judged: all texts with letters stay, and null languages stay null.
    No shuffle; all columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def kept(batches):
        for whole in batches:
            for batch in slices(whole, text_at, SLICE_SCORES // max(4, len(shared.value.languages))):
                if not shared.value.languages:
                    yield batch.filter(pa.array(_has_letters(batch.column(text_at)), pa.bool_()))
                    continue
                if fitting:
                    names, share, fits = _fits(shared.value, batch.column(text_at))
                else:
                    names, share = _predictions(shared.value, batch.column(text_at))
                    fits = np.ones(len(names), bool)
                filled = pc.coalesce(batch.column(lang_at), pa.array(names, batch.column(lang_at).type))
                good = [n != "und" and s >= min_share and bool(f) for n, s, f in zip(names, share, fits)]
                yield batch.set_column(lang_at, batch.schema.field(lang_at).name, filled).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def language_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, last_word, lang): maximal runs of words of one language; none for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches):
        model = shared.value
        for batch in _steps(batches, model):
            if not model.languages:
                continue
            offsets, states, _ = _labelled(model, batch.column(1))
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            first = np.ones(len(states), bool)
            first[1:] = (states[1:] != states[:-1]) | (row_of[1:] != row_of[:-1])
            at = np.flatnonzero(first)
            last = np.concatenate([at[1:], [len(states)]])[:len(at)] - 1
            rows = row_of[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(at - offsets[rows]), pa.array(last - offsets[rows]),
                 pa.array([model.languages[s] for s in states[at]], pa.string())], [id_col, "first_word", "last_word", "lang"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(spans, f"`{id_col}` {kind}, first_word long, last_word long, lang string")


@query("op8_language_id")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
