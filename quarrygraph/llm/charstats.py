"""Figures of whole texts from which the shape of a document is told, worked out for many documents at once.

All texts of a batch stand in one array of code points; classes, words, lines and documents are runs in it, so every
figure is a handful of array operations over the batch and no text is looked at by itself. The figures are general:
shares and transitions of character classes, the spread of line and word lengths, how regularly lines hold separators
and begin alike, repetition, common words, and how much the lines look like those of labelled documents of each shape
(``LineModel``). None of them names a kind of text.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters per array; a longer text stands alone.
CHUNK = 1_000_000
BLANK, NEWLINE, LOWER, UPPER, LETTER, HAN, DIGIT, MARK, END, INNER, QUOTE, BRACKET, DASH, PUNCT, SYMBOL, ODD = range(16)
CLASS_NAMES = ["blank", "newline", "lower", "upper", "letter", "han", "digit", "mark", "end", "inner", "quote", "bracket", "dash", "punct", "symbol", "odd"]
SEPARATORS = {"tab": "\t", "pipe": "|", "comma": ",", "semicolon": ";", "colon": ":"}
#: Sizes of the two tables of a line model: runs of classes and signs, and letters.
RUNS, LETTERS = 1 << 13, 1 << 14
_PRIME = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of every code point."""
    of = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lo": LETTER, "Lm": LETTER, "Pd": DASH, "Ps": BRACKET, "Pe": BRACKET, "Pi": QUOTE, "Pf": QUOTE, "Zs": BLANK, "Zl": NEWLINE, "Zp": NEWLINE}
    first = {"N": DIGIT, "M": MARK, "P": PUNCT, "S": SYMBOL, "C": ODD}
    cls = np.empty(sys.maxunicode + 1, np.uint8)
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        cat = unicodedata.category(ch)
        cls[c] = of[cat] if cat in of else first[cat[0]]
        if cat[0] == "L" and len(x := ch.lower()) == 1:
            low[c] = ord(x)
    cls[0x4E00:0xA000] = HAN
    for chars, k in ((".!?。!?…", END), (",;:,、;:", INNER), ("\"'", QUOTE), ("\t\x0b\x0c\x1c\x1d\x1e\x1f", BLANK), ("\n\x85", NEWLINE), ("�", ODD)):
        for ch in chars:
            cls[ord(ch)] = k
    return cls, low


@dataclass
class Batch:
    """Texts as arrays: code, class and document of each character; the bounds of lines with something in them; of words."""

    code: np.ndarray
    cls: np.ndarray
    low: np.ndarray
    doc: np.ndarray
    docs: int
    line_lo: np.ndarray
    line_hi: np.ndarray
    line_doc: np.ndarray
    line_of: np.ndarray  # of each character, -1 in blank lines
    word_lo: np.ndarray
    word_hi: np.ndarray
    word_doc: np.ndarray
    prefix: np.ndarray
    inverse: np.ndarray

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the lower-cased characters lo..hi-1."""
        return (self.prefix[hi] - self.prefix[lo]) * self.inverse[lo]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def batch(texts: list[str]) -> Batch:
    table, lower = tables()
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") + "\n" for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    cls, low = table[code], lower[code]
    n = len(code)
    ends = np.flatnonzero(cls == NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, int)
    seen = np.concatenate([[0], np.cumsum(cls > NEWLINE)])
    full = seen[ends] > seen[starts]
    line_of = np.repeat(np.where(full, np.cumsum(full) - 1, -1), ends - starts + 1) if len(ends) else np.zeros(0, int)
    lo, hi = starts[full], ends[full]
    # words: runs of letters, digits and marks, or one Han character
    inside = ((cls >= LOWER) & (cls <= MARK) & (cls != HAN)) | (((code == 0x27) | (code == 0x2019)) & (np.roll(cls, 1) >= LOWER) & (np.roll(cls, 1) <= LETTER))
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    han = np.flatnonzero(cls == HAN)
    w_lo, w_hi = np.concatenate([np.flatnonzero(step == 1), han]), np.concatenate([np.flatnonzero(step == -1), han + 1])
    order = np.argsort(w_lo, kind="stable")
    mixed = (low.astype(np.uint64) + np.uint64(1)) * np.uint64(_PRIME)
    mixed ^= mixed >> np.uint64(29)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(n, _STEP), dtype=np.uint64)])
    w_lo, w_hi = w_lo[order], w_hi[order]
    return Batch(code, cls, low, doc, len(texts), lo, hi, doc[lo] if n else lo, line_of, w_lo, w_hi, doc[w_lo] if n else w_lo, prefix, _powers(n + 1, pow(_STEP, -1, 1 << 64)))


def word_hash(word: str) -> int:
    b = batch([word])
    return int(b.hashes(np.array([0]), np.array([len(word)]))[0])


class Common:
    """Common words by hash: those set apart by spaces, and those in Han characters by length."""

    def __init__(self, spaced: list[str], han: list[str]):
        self.spaced = np.array(sorted(word_hash(w) for w in spaced), np.uint64)
        self.han = {n: np.array(sorted(word_hash(w) for w in han if len(w) == n), np.uint64) for n in {len(w) for w in han}}

    def counts(self, b: Batch) -> np.ndarray:
        """Per document: common words, and Han characters that common words cover."""
        hit = np.isin(b.hashes(b.word_lo, b.word_hi), self.spaced)
        out = np.bincount(b.word_doc[hit], minlength=b.docs).astype(float)
        at = np.flatnonzero(b.cls == HAN)
        covered = np.zeros(len(b.code), bool)
        for n, known in self.han.items():
            lo = at[at + n <= len(b.code)]
            lo = lo[np.isin(b.hashes(lo, lo + n), known)]
            for i in range(n):
                covered[lo + i] = True
        return out + np.bincount(b.doc[covered], minlength=b.docs)


def _grams(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line and bucket of each run of three classes or signs, and of each three letters."""
    keep = b.line_of >= 0
    line, cls, code, low = b.line_of[keep], b.cls[keep], b.code[keep], b.low[keep]
    sign = np.where((cls >= LOWER) & (cls <= MARK), cls, np.where(code < 128, code + 16, cls.astype(np.uint32) + 200)).astype(np.uint64)
    sign[cls <= NEWLINE] = 1
    sign[code == 9] = 2
    first = np.concatenate([[True], (sign[1:] != sign[:-1]) | (line[1:] != line[:-1])]) if len(sign) else np.zeros(0, bool)
    # a run of blanks is told apart from a single one
    wide = np.flatnonzero(~first & (sign == 1))
    s, l = sign.copy(), line
    s[np.maximum(wide - 1, 0)] = 3
    s, l = s[first], l[first]

    def three(v: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(v) < 3:
            return np.zeros(0, int), np.zeros(0, int)
        ok = of[2:] == of[:-2]
        h = (v[:-2] * np.uint64(1_000_003) + v[1:-1]) * np.uint64(1_000_003) + v[2:]
        h = (h * np.uint64(_PRIME)) >> np.uint64(64 - size.bit_length() + 1)
        return of[2:][ok], h[ok].astype(np.int64)

    return *three(s, l, RUNS), *three(low.astype(np.uint64), line, LETTERS)


class LineModel:
    """How often three runs of classes, and three letters, follow one another in labelled documents of each shape; lines are scored by these."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.runs, self.letters = np.ones((len(labels), RUNS)), np.ones((len(labels), LETTERS))

    def add(self, b: Batch, label: np.ndarray) -> None:
        """Counts documents of shape ``label`` (an index per document)."""
        of_line = label[b.line_doc]
        l1, g1, l2, g2 = _grams(b)
        self.runs += np.bincount(of_line[l1] * RUNS + g1, minlength=self.runs.size).reshape(self.runs.shape)
        self.letters += np.bincount(of_line[l2] * LETTERS + g2, minlength=self.letters.size).reshape(self.letters.shape)

    def ready(self) -> tuple[np.ndarray, np.ndarray]:
        log = lambda c: np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
        return log(self.runs), log(self.letters)


def line_scores(b: Batch, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each line under each shape: by runs, and by letters."""
    l1, g1, l2, g2 = _grams(b)
    n = len(b.line_lo)
    total = lambda line, gram, table: np.stack([np.bincount(line, t[gram], minlength=n) for t in table], 1)
    return total(l1, g1, model[0]), total(l2, g2, model[1])


def _mode_share(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, least: int = 0) -> np.ndarray:
    """Per document the greatest share of weight on lines of one and the same value (from ``least`` on)."""
    v = np.minimum(value, 63)
    per = np.bincount(doc * 64 + v, weight, minlength=docs * 64).reshape(docs, 64)
    return per[:, least:].max(1) / np.maximum(per.sum(1), 1)


def features(texts: list[str], common: Common, model: tuple[np.ndarray, np.ndarray], labels: list[str], wanted: frozenset[str] | None = None) -> dict[str, np.ndarray]:
    """Named figures, one number per text each: all, or at least the ``wanted`` ones."""
    need = lambda *names: wanted is None or any(w in names for w in wanted)
    b = batch(texts)
    n, out = b.docs, {}
    div = lambda x, y: x / np.where(y > 0, y, 1)
    per_class = np.bincount(b.doc.astype(np.int64) * 16 + b.cls, minlength=n * 16).reshape(n, 16).astype(float)
    chars = per_class.sum(1)
    seen = per_class[:, 2:].sum(1)
    for k, name in enumerate(CLASS_NAMES):
        out[f"{name}_share"] = div(per_class[:, k], chars if k < 2 else seen)
    cls = b.cls.astype(np.int64)
    # how classes follow one another
    if need("class_entropy", "change_share", "case_change_share", "digit_letter_share", "inside_share", "comma_blank_share", "end_blank_share"):
        same = b.doc[1:] == b.doc[:-1]
        pair = np.bincount(b.doc[1:][same].astype(np.int64) * 256 + cls[:-1][same] * 16 + cls[1:][same], minlength=n * 256).reshape(n, 16, 16).astype(float)
        row = pair.sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(row[:, :, None] > 0, pair / row[:, :, None], 0)
            h = -np.where(p > 0, p * np.log2(p), 0).sum(2)
        out["class_entropy"] = div((h * row).sum(1), row.sum(1))
        out["change_share"] = 1 - div(np.einsum("nii->n", pair), row.sum(1))
        word_like = [LOWER, UPPER, LETTER, HAN, DIGIT]
        out["case_change_share"] = div(pair[:, LOWER, UPPER], seen)
        out["digit_letter_share"] = div(pair[:, DIGIT, LOWER] + pair[:, LOWER, DIGIT] + pair[:, UPPER, DIGIT] + pair[:, DIGIT, UPPER], seen)
        out["inside_share"] = div(sum(pair[:, i, j] for i in word_like for j in (END, INNER, PUNCT, DASH, SYMBOL, BRACKET)), seen)
        out["comma_blank_share"] = div(pair[:, INNER, BLANK], chars)
        out["end_blank_share"] = div(pair[:, END, BLANK] + pair[:, END, NEWLINE] + pair[:, END, HAN], chars)
    if need("char_entropy"):
        byte = np.bincount(b.doc.astype(np.int64) * 256 + np.minimum(b.low, 255).astype(np.int64), minlength=n * 256).reshape(n, 256)
        q = byte / np.maximum(byte.sum(1, keepdims=True), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["char_entropy"] = -np.where(q > 0, q * np.log2(q), 0).sum(1)
    # words
    length = (b.word_hi - b.word_lo).astype(float)
    words = np.bincount(b.word_doc, minlength=n).astype(float)
    mean = div(np.bincount(b.word_doc, length, minlength=n), words)
    out["words"], out["mean_word_length"] = words, mean
    out["word_length_spread"] = np.sqrt(np.maximum(div(np.bincount(b.word_doc, length**2, minlength=n), words) - mean**2, 0))
    out["long_word_share"] = div(np.bincount(b.word_doc, np.where(length >= 20, length, 0), minlength=n), seen)
    first = b.cls[b.word_lo]
    out["capital_share"] = div(np.bincount(b.word_doc[(first == UPPER) & (length > 1)], minlength=n), words)
    if need("common_share"):
        out["common_share"] = div(common.counts(b), words)
    h1 = b.hashes(b.word_lo, b.word_hi) if need("word_kinds", "phrase_kinds") else b.word_lo

    def kinds(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, doc))
        hs, ds = hashes[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.zeros(0, bool)
        return np.where(np.bincount(ds, minlength=n) > 0, div(np.bincount(ds[new], minlength=n).astype(float), np.bincount(ds, minlength=n)), 1.0)

    if need("word_kinds"):
        out["word_kinds"] = kinds(h1, b.word_doc)
    if need("phrase_kinds"):
        k = np.uint64(1_000_003)
        three = h1[:-2] * k * k + h1[1:-1] * k + h1[2:] if len(h1) > 2 else h1[:0]
        ok = b.word_doc[2:] == b.word_doc[:-2] if len(h1) > 2 else np.zeros(0, bool)
        out["phrase_kinds"] = kinds(three[ok], b.word_doc[2:][ok] if len(h1) > 2 else b.word_doc[:0])
    # pieces between blanks
    if need("piece_length", "wide_share", "plain_share", "wordless_share"):
        inner = b.cls > NEWLINE
        edge = np.diff(np.concatenate([[0], inner.view(np.int8), [0]]))
        p_lo, p_hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p_doc, p_len = b.doc[p_lo] if len(p_lo) else np.zeros(0, np.int32), (p_hi - p_lo).astype(float)
        pieces = np.bincount(p_doc, minlength=n)
        alpha = np.concatenate([[0], np.cumsum((cls >= LOWER) & (cls <= HAN))])
        low_run = np.concatenate([[0], np.cumsum(cls == LOWER)])
        out["piece_length"] = div(np.bincount(p_doc, p_len, minlength=n), pieces)
        out["wide_share"] = div(np.bincount(p_doc, np.where((p_len > 40), p_len, 0), minlength=n), seen)
        plain = (low_run[np.maximum(p_hi - 1, p_lo)] - low_run[np.minimum(p_lo + 1, p_hi)] >= p_len - 2) & (p_len > 1)
        out["plain_share"] = div(np.bincount(p_doc[plain], minlength=n).astype(float), pieces)
        out["wordless_share"] = div(np.bincount(p_doc, np.where(alpha[p_hi] - alpha[p_lo] == 0, p_len, 0), minlength=n), seen)
    # lines
    inner = b.cls > NEWLINE
    size = (b.line_hi - b.line_lo).astype(float)
    lines, all_ = np.bincount(b.line_doc, minlength=n).astype(float), np.bincount(b.line_doc, size, minlength=n)
    by_char = lambda mask: div(np.bincount(b.line_doc, np.where(mask, size, 0), minlength=n), all_)
    mean = div(all_, lines)
    out["lines"], out["mean_line_length"] = lines, mean
    out["line_length_spread"] = div(np.sqrt(np.maximum(div(np.bincount(b.line_doc, size**2, minlength=n), lines) - mean**2, 0)), mean)
    out["short_lines"], out["long_lines"] = by_char(size <= 60), by_char(size >= 120)
    if need("line_kinds"):
        out["line_kinds"] = kinds(b.hashes(b.line_lo, b.line_hi), b.line_doc)
    if need("lower_begin_lines", "upper_begin_lines", "digit_begin_lines", "sign_begin_lines", "bracket_begin_lines", "end_end_lines", "inner_end_lines", "digit_end_lines", "bracket_end_lines", "word_end_lines", "alike_begin_lines"):
        filled = np.flatnonzero(inner & (b.line_of >= 0))
        of = b.line_of[filled]
        head, tail = np.zeros(len(size), int), np.zeros(len(size), int)
        if len(filled):
            f = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            head, tail = filled[f], filled[np.concatenate([f[1:] - 1, [len(filled) - 1]])]
        begins, ends = b.cls[head] if len(head) else head, b.cls[tail] if len(tail) else tail
        for name, group in {"lower": [LOWER], "upper": [UPPER], "digit": [DIGIT], "sign": [DASH, PUNCT, SYMBOL], "bracket": [BRACKET]}.items():
            out[f"{name}_begin_lines"] = by_char(np.isin(begins, group))
        for name, group in {"end": [END], "inner": [INNER], "digit": [DIGIT], "bracket": [BRACKET], "word": [LOWER, UPPER, LETTER, HAN]}.items():
            out[f"{name}_end_lines"] = by_char(np.isin(ends, group))
        out["alike_begin_lines"] = _mode_share(b.line_doc.astype(np.int64), begins.astype(np.int64), size, n)
    per_line = np.bincount(b.line_of[b.word_lo][b.line_of[b.word_lo] >= 0], minlength=len(size)) if len(size) else np.zeros(0, int)
    out["few_word_lines"] = by_char(per_line <= 8)
    out["alike_word_lines"] = _mode_share(b.line_doc.astype(np.int64), per_line.astype(np.int64), size, n)
    if need("tab_lines", "alike_tab_lines", "pipe_lines", "alike_pipe_lines", "comma_lines", "alike_comma_lines", "semicolon_lines", "alike_semicolon_lines", "colon_lines", "alike_colon_lines", "blanks_lines", "alike_blanks_lines", "cell_lines", "alike_cell_lines"):
        blanks = np.flatnonzero((cls[:-1] == BLANK) & (cls[1:] == BLANK)) if len(cls) > 1 else np.zeros(0, int)
        signs = {name: np.flatnonzero(b.code == ord(s)) for name, s in SEPARATORS.items()} | {"blanks": blanks}
        best = np.zeros(n)
        for name, at in signs.items():
            at = b.line_of[at]
            count = np.bincount(at[at >= 0], minlength=len(size)) if len(size) else np.zeros(0, int)
            out[f"{name}_lines"] = by_char(count > 0)
            alike = _mode_share(b.line_doc.astype(np.int64), count.astype(np.int64), size, n, 1)
            out[f"alike_{name}_lines"] = alike
            best = np.maximum(best, alike)
        out["alike_cell_lines"] = best
    # likeness to labelled lines
    if wanted is None or any("_like_" in w or w == "prose_letters" for w in wanted):
        runs, letters = line_scores(b, model)
        both = (runs + letters).argmax(1) if len(size) else np.zeros(0, int)
        prose = labels.index("prose")
        for i, label in enumerate(labels):
            out[f"{label}_like_lines"] = by_char(both == i)
            if i != prose:
                out[f"{label}_like_runs"] = div(np.bincount(b.line_doc, runs[:, i] - runs[:, prose], minlength=n), all_)
                out[f"{label}_like_letters"] = div(np.bincount(b.line_doc, letters[:, i] - letters[:, prose], minlength=n), all_)
        out["prose_letters"] = div(np.bincount(b.line_doc, letters[:, prose], minlength=n), all_)
    return out


def chunks(texts: list[str]) -> list[tuple[int, int]]:
    """Bounds of runs of texts with at most CHUNK characters, or one text."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t) + 1
    return [*out, (lo, len(texts))] if texts else []
