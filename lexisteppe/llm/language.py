"""Language of documents, paragraphs and lines (problem 2), by error-correcting output codes.

Each language has a codeword of all two-class splits of the languages (15 bits for five). A binary logistic
classifier over the letter n-grams of words predicts each bit; loss-weighted decoding adds up each codeword's
logistic loss, bits weighed by the training accuracy of their classifiers, and takes the nearest codeword. The
confidence is the codeword's share of exp(-loss); below ``AMBIGUOUS`` a sentence is flagged and takes the language
of its line, or of its document. Sentences are classified, then lines, paragraphs and documents add up letters.

Defined results: null and empty texts and texts or lines without letters get no row; capitalised words inside a
sentence (names) count as letters but not as evidence; with labels of fewer than two languages scripts decide
nothing and everything gets the one language, or none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

LANGUAGES = ("ar", "en", "kk", "ru", "zh")
MIXED = "mixed"
AMBIGUOUS = 0.5
BUCKETS = 1 << 15
WORDS = re.compile(r"[^\W\d_]+")
LETTER = regex.compile(r"\p{L}")
SENTENCES = re.compile(r"[.!?…](?:\s+|$)|[。！？؟]|\s[/|]\s")
WEB = re.compile(r"<[^>]*>|[\w.+\-]*\s?(?:@|[(\[](?:at|собака|dog)[)\]])\s?[\w.\-]+|[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+")


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams of one to four letters, its borders marked."""
    marked = f"^{word.lower()}$".encode("utf-32-le")
    n = len(marked) // 4
    return [zlib.crc32(marked[4 * i : 4 * (i + k)]) % BUCKETS for k in (1, 2, 3, 4) for i in range(n - k + 1)]


def codewords(n: int) -> np.ndarray:
    """The exhaustive code: each split of n classes into two, once; rows of -1 and 1."""
    bits = np.arange(1, 1 << (n - 1))
    return np.array([[1 if k == 0 or not b >> (k - 1) & 1 else -1 for b in bits] for k in range(n)], np.float32).reshape(n, -1)


class Coder:
    """Weights of the binary classifiers, the languages' codewords and the weight of each bit."""

    def __init__(self, languages: list[str], weights: np.ndarray, bits: np.ndarray) -> None:
        self.languages, self.weights, self.bits = languages, weights, bits
        self.code = codewords(len(languages))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, weights.shape[1]), np.float32)

    def __reduce__(self) -> tuple:
        return Coder, (self.languages, self.weights, self.bits)

    def row(self, word: str) -> int:
        """The row of a word in the table of margins, found once for each distinct word."""
        at = self.rows.get(word)
        if at is None:
            if len(self.rows) >= 400_000:
                self.rows.clear()
            at = self.rows[word] = len(self.rows)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.weights[grams(word)].mean(0)
        return at

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, confidence) for rows of margins."""
        losses = np.stack([(np.logaddexp(0, -margins * c) * self.bits).sum(1) for c in self.code], 1)
        best = losses.argmin(1)
        share = np.exp(losses.min(1, keepdims=True) - losses)
        return best, 1 / share.sum(1)

    def classify(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence of each list of words, all in one step."""
        sizes = np.array([len(s) for s in sentences])
        known = self.rows
        rows = np.array([known[w] if w in known else self.row(w) for s in sentences for w in s])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        margins = np.add.reduceat(self.table[rows], starts, 0) / np.sqrt(sizes)[:, None]
        return self.decode(margins)


def evidence(words: list[str]) -> list[str]:
    """The words that speak for a language: without capitalised words after the first, if any are left."""
    rest = [w for w in words[1:] if not w[0].isupper()]
    return words[:1] + rest if rest else words


def split(line: str) -> list[list[str]]:
    """The sentences of a line as lists of words, without addresses of the web.

    A stop after one or two letters (initials, short forms) ends none.
    """
    return [words for _, _, words in segments(line)]


def segments(line: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a line, as :func:`split` takes them."""
    if "@" in line or "<" in line or "[" in line or "(" in line or "." in line[:-1]:
        line = WEB.sub(lambda m: " " * len(m.group()), line)
    out: list[tuple[int, int, list[str]]] = []
    joined = False
    at = 0
    for end, after in [*(m.span() for m in SENTENCES.finditer(line)), (len(line), len(line))]:
        words = WORDS.findall(line, at, end)
        if words:
            if joined:
                out[-1] = (out[-1][0], after, out[-1][2] + words)
            else:
                out.append((at, after, words))
            joined = len(words[-1]) < 3
        at = after
    return out


def line_spans(coder: Coder, line: str) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, language, confidence, ambiguous) of the pieces of a line, neighbours of one language together.

    A sentence below ``AMBIGUOUS`` is flagged and keeps the language of its own nearest codeword; it is not joined
    with its neighbours.
    """
    parts = segments(line)
    if not parts:
        return []
    best, sure = (x.tolist() for x in coder.classify([evidence(words) for _, _, words in parts]))
    out: list[list] = []
    for (start, end, words), k, p in zip(parts, best, sure, strict=True):
        letters, doubtful = sum(map(len, words)), p < AMBIGUOUS
        if out and out[-1][2] == coder.languages[k] and not doubtful and not out[-1][4]:
            last = out[-1]
            last[1], last[3], last[5] = end, (last[3] * last[5] + p * letters) / (last[5] + letters), last[5] + letters
        else:
            out.append([start, end, coder.languages[k], p, doubtful, letters])
    found = []
    for start, end, language, p, doubtful, _ in out:
        piece = line[start:end]
        found.append((start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip()), language, p, doubtful))
    return found


def train(rows: list[tuple[str, str]], steps: int = 40, rate: float = 0.5, decay: float = 1e-7) -> Coder | None:
    """Fit the coder to the distinct sentences of labelled texts, then again without those it puts elsewhere.

    Wrong labels are a few in a hundred of each language's texts but may be the half of a rare language's labels;
    the first fit takes every sentence for what it is mostly labelled, so the second is free of most of them.
    """
    samples = [(label, list(s)) for label, s in sorted({(label, tuple(evidence(s))) for text, label in rows for line in text.split("\n") for s in split(line)})]
    coder = _fit(samples, steps, rate, decay)
    if coder is None or len(coder.languages) == 1:
        return coder
    best, _ = coder.classify([s for _, s in samples])
    return _fit([x for x, k in zip(samples, best.tolist(), strict=True) if coder.languages[k] == x[0]], steps, rate, decay) or coder


def _fit(samples: list[tuple[str, list[str]]], steps: int, rate: float, decay: float) -> Coder | None:
    """Binary classifiers of all bits by full-batch gradient descent (Adagrad) on the logistic loss."""
    languages = sorted({label for label, _ in samples})
    if not languages:
        return None
    code = codewords(len(languages))
    if len(languages) == 1:
        return Coder(languages, np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32))
    words = {w: i for i, w in enumerate(dict.fromkeys(w for _, s in samples for w in s))}
    parts = [grams(w) for w in words]
    sizes = np.array([len(p) for p in parts])
    flat = np.array([g for p in parts for g in p])
    word_of = np.repeat(np.arange(len(parts)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids = np.array([words[w] for _, s in samples for w in s])
    lengths = np.array([len(s) for _, s in samples])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scale = (1 / np.sqrt(lengths)).astype(np.float32)[:, None]
    sample_of = np.repeat(np.arange(len(samples)), lengths)
    target = code[[languages.index(label) for label, _ in samples]]
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    squares = np.full_like(weights, 1e-12)
    by_word = np.argsort(ids, kind="stable")
    word_starts = np.searchsorted(ids[by_word], np.arange(len(parts)))
    by_gram = np.argsort(flat, kind="stable")
    used, gram_starts = np.unique(flat[by_gram], return_index=True)
    for _ in range(steps):
        scores = np.add.reduceat(weights[flat], starts, 0) / sizes[:, None]
        margins = np.add.reduceat(scores[ids], begins, 0) * scale
        slope = -target / (1 + np.exp(np.clip(target * margins, -30, 30))) * scale / len(samples)
        at_word = np.add.reduceat(slope[sample_of[by_word]], word_starts, 0) / sizes[:, None]
        gradient = np.add.reduceat(at_word[word_of[by_gram]], gram_starts, 0) + decay * weights[used]
        squares[used] += gradient**2
        weights[used] -= rate * gradient / np.sqrt(squares[used])
    right = np.clip(((margins * target) > 0).mean(0), 0.51, 0.999)
    bits = np.log(right / (1 - right))
    return Coder(languages, weights, (bits / bits.mean()).astype(np.float32))


def labelled(texts: DataFrame, id_column: str, most: int) -> list[tuple[str, str]]:
    """At most ``most`` texts whose label is a plain language code, those with the lowest hashes of their id.

    Hashes above about twice the share wanted are left out where they are read, so that the tasks together send
    the driver few texts more than it keeps.
    """
    plain = texts.where(F.col("lang").isin(*LANGUAGES))
    bound = min(1.0, (2 * most + 200) / max(1, plain.count()))
    rows = plain.where(F.col("text").isNotNull()).select("text", "lang", F.xxhash64(id_column).alias("_h"), id_column)
    near = rows.where(F.col("_h") <= min(2**63 - 1, int(-(2**63) + bound * 2**64)))
    return [(r.text, r.lang) for r in near.orderBy("_h", id_column).limit(most).collect()]


def judge(coder: Coder, texts: list[str | None], least_share: float = 0.2) -> Iterator[tuple[str, float, list[tuple[int, str, float]]] | None]:
    """For each text its language, confidence and (line_no, language, confidence) of its lines, or None without letters."""
    sentences: list[list[str]] = []
    letters: list[int] = []
    shape: list[list[tuple[int, int]] | None] = []
    for text in texts:
        lines = None
        if text and LETTER.search(text):
            lines = []
            for i, line in enumerate(text.split("\n")):
                parts = split(line)
                if parts:
                    sentences += [evidence(p) for p in parts]
                    letters += [sum(map(len, p)) for p in parts]
                    lines.append((i, len(parts)))
        shape.append(lines)
    if sentences:
        best, sure = (x.tolist() for x in coder.classify(sentences))
    at = 0
    n = len(coder.languages)
    for lines in shape:
        if lines is None:
            yield None
            continue
        by_line = []
        total, trust = [0] * n, 0.0
        for i, k in lines:
            span = range(at, at + k)
            own = [0] * n
            for j in span:
                if sure[j] >= AMBIGUOUS:
                    own[best[j]] += letters[j]
            by_line.append((i, span, own))
            total = [a + b for a, b in zip(total, own, strict=True)]
            at += k
        everywhere = max(range(n), key=lambda c: total[c]) if any(total) else None
        total, out = [0] * n, []
        for i, span, own in by_line:
            main = max(range(n), key=lambda c: own[c]) if any(own) else everywhere
            for j in span:
                if sure[j] < AMBIGUOUS and main is not None:
                    own[main] += letters[j]
                elif sure[j] < AMBIGUOUS:
                    own[best[j]] += letters[j]
            size = sum(letters[j] for j in span)
            weight = sum(sure[j] * letters[j] for j in span) / size
            trust += weight * size
            main = max(range(n), key=lambda c: own[c])
            out.append((i, MIXED if sum(x > 0 for x in own) > 1 else coder.languages[main], weight))
            total = [a + b for a, b in zip(total, own, strict=True)]
        size = sum(total)
        ranked = sorted(total, reverse=True)
        language = MIXED if n > 1 and ranked[1] >= least_share * size else coder.languages[total.index(ranked[0])]
        yield language, trust / size, out


def languages(texts: DataFrame, coder: Coder | None, id_column: str, with_lines: bool, least_share: float = 0.2, stored: str | None = None) -> DataFrame:
    """(row_id, line_no, lang, confidence, stored): line_no -1 for the whole text, then the lines of mixed texts.

    ``stored`` names a column that is passed on with every row, null where there is none.
    """
    sent = texts.sparkSession.sparkContext.broadcast(coder)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            out: list[tuple[int, int, str, float, str | None]] = []
            if known is not None:
                for row, label, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), judge(known, b.column(1).to_pylist(), least_share), strict=True):
                    if found is not None:
                        out.append((row, -1, found[0], found[1], label))
                        if with_lines and found[0] == MIXED:
                            out += [(row, *line, label) for line in found[2]]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row_id", "line_no", "lang", "confidence", "stored"])

    label = F.col(stored) if stored else F.lit(None).cast("string")
    return arrow_map(texts.select(id_column, "text", label.alias("_stored")), kernel, "row_id bigint, line_no int, lang string, confidence double, stored string", 500)


def language_spans(texts: DataFrame, coder: Coder | None, id_column: str) -> DataFrame:
    """(row_id, line_no, start_pos, end_pos, lang, confidence, ambiguous): the pieces of every line by language.

    Positions are code points in the line, without white space around; lines without words have none.
    """
    sent = texts.sparkSession.sparkContext.broadcast(coder)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            out: list[tuple] = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and known is not None:
                    out += [(row, n, *span) for n, line in enumerate(text.split("\n")) for span in line_spans(known, line)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row_id", "line_no", "start_pos", "end_pos", "lang", "confidence", "ambiguous"])

    return arrow_map(texts.select(id_column, "text"), kernel, "row_id bigint, line_no int, start_pos int, end_pos int, lang string, confidence double, ambiguous boolean", 500)


def corpus_coder(documents: DataFrame, contexts: DataFrame, most_documents: int = 400, most_paragraphs: int = 5_000) -> Coder | None:
    """The coder of a collection, from bounded samples of its labelled documents and paragraphs."""
    return train(labelled(documents, "doc_id", most_documents) + labelled(contexts, "para_id", most_paragraphs))
