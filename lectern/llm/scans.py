"""Text from scanned pages: lines labelled as header, number, body or break by a linear-chain model over layout
features, then paragraphs put together again, broken words joined and misread characters repaired.

The model is an averaged structured perceptron with Viterbi decoding, fitted on notes whose true text is known. Words
for joining and repairing are counted over the whole corpus. A misread word and its true form have one folded form, in
which all lookalikes are spelled alike, so candidates are found by that key, however many characters are damaged, and then
verified. Words above a share of all words, whose number has a bound, go to the tasks; what depends on rarer ones is
asked of the full table of words by a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scale import all_cores, cut, release

LABELS = ("body", "break", "header", "number")
#: Bounds of the sample the line model is fitted on: transcripts (the smallest by a hash of note_id) and characters of a
#: note; passes over it.
MOST_TRANSCRIPTS, MOST_CHARS, PASSES = 600, 100_000, 6
#: Share of all words from which a word goes to the tasks (at most the inverse of it do); the result doesn't depend on it.
WORD_SHARE = 2e-6
#: Least count of a true word, and how many times as frequent it must be as the misread one: in general, and for words
#: rarer than the least count that are damaged in one way alone.
LEAST_COUNT, REPAIR_RATIO, RARE_RATIO = 4, 30, 5
#: Share of all words, and count, from which both halves of a word broken at a hyphen are words of their own.
PART_SHARE, PART_COUNT = 1e-5, 50

#: What scanners take for what, fixed values: the sign read, and the true one.
LOOKALIKES = (("c", "e"), ("@", "a"), ("+", "t"), ("5", "s"), ("1", "l"), ("1", "i"), ("0", "o"), ("ri", "n"), ("ii", "u"), ("b", "h"), ("6", "b"), ("rn", "m"), ("9", "g"), ("vv", "w"), ("m", "rn"))
#: Marks that break a word at a line end, fixed values.
BREAK_MARKS = "-¬­‐‑‒–—−"

TOKEN = re.compile(r"(?:[^\W_]|[@+])+", re.UNICODE)
BARE_NUMBER = re.compile(r"\d{1,4}\Z")
PAGE_NUMBER = re.compile(r"(?:[-–—~(\[|]\s*\d{1,4}\s*[-–—~)\]|]|(?:page|pg|p|pp|seite|s)\b\.?\s*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|\d{1,4})\Z", re.I)
ROMAN = re.compile(r"[-–~\[(]?\s*(?=[ivxl])(?:x{0,3}|xl|l)(?:ix|iv|v?i{0,3})\s*[-–~\])]?\Z")
#: Marks of a question at the end of a line: content, and the end of a sentence.
MARKS_NOTE = re.compile(r"\s*(?:[(\[]\s*(?:marks?\s*:?\s*)?\d{1,3}\s*(?:marks?|m)?\s*[)\]]|[-–]\s*\d{1,3}\s*marks?|\(marks?:|(?<=\d )m(?:arks?)?[)\]])\s*[.]?\Z", re.I)
#: Words that running heads are made of, fixed values.
HEAD_WORDS = frozenset("academy board college department exam examination faculty institute lecture notes paper polytechnic school semester term test university".split())
_MARKS = frozenset(BREAK_MARKS)
BREAK_END = re.compile(rf"([^\W\d_][\w@+]*(?:-[\w@+]+)*)([{BREAK_MARKS}])\s*\Z")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
HEAD_WORD = re.compile(r"[\w@+]+")


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _without_marks(line: str) -> str:
    """A line without a note of marks at its end, which then ends a sentence."""
    if line[-1:] not in (")", "]", "s", "S", "k", "K", "."):
        return line
    if PAGE_NUMBER.match(line) and not (line[0] == "(" and line[-1] == ")"):
        return line
    found = MARKS_NOTE.search(line[-24:])
    return line[: len(line) - len(line[-24:]) + found.start()] + "." if found else line


def line_features(lines: list[str], page: int | None) -> list[list[str]]:
    """Layout features of each line and its neighbours."""
    plain = [" ".join(x.split()) for x in lines]
    plain = [_without_marks(x) for x in plain]
    every = [w for x in plain for w in x.split() if w[0].isalpha()]
    cased = sum(1 for w in every if w[0].isupper()) > 0.6 * len(every)  # set in capitals throughout: they tell nothing
    width = max((len(x) for x in plain), default=0) or 1
    full = [k for k, x in enumerate(plain) if x]
    order = {k: n for n, k in enumerate(full)}
    out = []
    for k, s in enumerate(plain):
        if not s:
            out.append(["blank"])
            continue
        n = order[k]
        before = plain[full[n - 1]] if n else ""
        after = plain[full[n + 1]] if n + 1 < len(full) else ""
        words = s.split()
        letters = [w for w in words if any(c.isalpha() for c in w)]
        capital = sum(1 for w in letters if w[0].isupper() or (not w[0].isalpha() and w.strip("([")[:1].isupper())) / len(letters) if letters else 0.0
        ends = s[-1] in ".?!:;,"
        if cased:
            capital = 0.0
        f = ["bias", f"words{min(len(words), 8)}", "ends" if ends else "open"]
        f.append("first" if not n else "last" if n == len(full) - 1 else "inner")
        if s[0].islower():
            f.append("lower")
        if not cased and letters and s.upper() == s and sum(map(len, letters)) > 5:
            f.append("upper")
        if s[0] in "|#=<{*" or s.rstrip("\"'”’»)")[-1:] in (".", "?", "!", ";") or ". " in s or ": " in s or "? " in s or "! " in s or "; " in s or sum(map(len, letters)) < 6:
            f.append("no-head")
        elif not cased and any(w[0].isupper() and w.strip("(),:").lower() in HEAD_WORDS for w in letters):
            f.append("head-word")
        if letters:
            f.append(f"capital{int(capital * 4)}")
            if capital >= 0.6 and not ends:
                f.append(f"title{min(len(letters), 4)}")
                if len(letters) >= 3 and before and after and not before[-1] in ".?!:" and after[0].islower():
                    f.append("title-interrupts")
        if capital >= 0.5 and s[0].isdigit() and re.match(r"\s*\d{1,4}\s{2,}[A-Z]", lines[k]):
            f.append("number-then-title")
        if "|" in s and re.search(r"\|\s*\d{1,4}\s*$", s):
            f.append("title-then-number")
        if not ends and (" - " in s or " – " in s or " / " in s or " | " in s):
            f.append("separator")
        if capital >= 0.5 and ("19" in s or "20" in s) and re.search(r"\b(?:19|20)\d\d\b", s):
            f.append("year")
        short = len(s) < 0.75 * width
        f.append("short" if short else "wide")
        starts_low = bool(after) and after[0].islower()
        if before and before[-1] not in ".?!:" and starts_low and not BARE_NUMBER.match(before):
            f.append("interrupts")
            if short and not ends:
                f.append("short-interrupts")
        if not before or before[-1] in ".?!)]":
            f.append("after-end")
        number, roman = bool(PAGE_NUMBER.match(s)), bool(ROMAN.match(s))
        if number:
            bare = bool(BARE_NUMBER.match(s))
            f.append("bare" if bare else "decorated")
            if bare:
                near = bool(BARE_NUMBER.match(before)) + bool(BARE_NUMBER.match(after))
                heading = bool(before) and not before[-1] in ".?!,;:" and len(before.split()) <= 3 and before[:1].isupper() and not any(c.isdigit() for c in before)
                heading |= bool(before) and before[-1] == ":"
                f.append(f"near{near}{'h' if heading else ''}")
                f.append("page" if page is not None and int(s) == page else "no-page")
                f.append(f"near{near}{'h' if heading else ''}-{'page' if page is not None and int(s) == page else 'no'}-{f[3]}")
        elif roman:
            f += ["roman", "decorated"]
        if BARE_NUMBER.match(after):
            f.append("before-number")
            if len(words) <= 3 and not ends:
                f.append("list-title")
        out.append(f)
    return out


#: Labels out of the question for figures, blank lines, lines of words, and lines that end a sentence.
_NUMERAL, _BLANK, _WORDS, _TEXT = (np.array([0.0 if x in may else -1e9 for x in LABELS]) for may in (("body", "number"), ("break",), ("body", "header"), ("body",)))


class LineModel:
    """Weights of features by label and of label pairs."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.kept: dict | None = None

    def _own(self, f: list[str]) -> np.ndarray:
        """Score of each label by a line's features; those of a fitted model are kept, as layouts recur."""
        key = tuple(f) if self.kept is not None else None
        if key in (self.kept or ()):
            return self.kept[key]
        own = sum((self.weights[x] for x in f if x in self.weights), np.zeros(len(LABELS)))
        own = own + (_NUMERAL if "bare" in f or "decorated" in f else _BLANK if "blank" in f else _TEXT if "no-head" in f else _WORDS)
        if key is not None and len(self.kept) < 200_000:
            self.kept[key] = own
        return own

    def labels(self, features: list[list[str]]) -> list[int]:
        """The best label sequence (Viterbi)."""
        none = np.zeros(len(LABELS))
        back, score = [], none
        for k, f in enumerate(features):
            own = self._own(f)
            if k:
                ways = score[:, None] + self.moves
                back.append(ways.argmax(axis=0))
                score = ways.max(axis=0) + own
            else:
                score = own + 0.0
        path = [int(score.argmax())] if features else []
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def fit(self, examples: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, seed: int = 3) -> LineModel:
        rng = np.random.default_rng(seed)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LABELS)))
        total_moves, step = np.zeros_like(self.moves), 1
        live: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LABELS)))
        self.weights = live
        for _ in range(passes):
            for i in rng.permutation(len(examples)):
                features, gold = examples[i]
                guess = self.labels(features)
                if guess != gold:
                    for k, f in enumerate(features):
                        if guess[k] != gold[k]:
                            for x in f:
                                live[x][gold[k]] += 1
                                live[x][guess[k]] -= 1
                                total[x][gold[k]] += step
                                total[x][guess[k]] -= step
                        if k and (guess[k - 1], guess[k]) != (gold[k - 1], gold[k]):
                            for path, sign in ((gold, 1), (guess, -1)):
                                self.moves[path[k - 1], path[k]] += sign
                                total_moves[path[k - 1], path[k]] += sign * step
                step += 1
        self.weights = {x: w - total[x] / step for x, w in live.items()}
        self.moves = self.moves - total_moves / step
        self.kept = {}
        return self


_FOLD = str.maketrans({"c": "e", "@": "a", "+": "t", "5": "s", "1": "l", "i": "l", "0": "o", "h": "b", "6": "b", "9": "g"})


def folded(text: str) -> str:
    """Letters and digits of a text with lookalikes made equal, to find scanned lines in a true text."""
    out = "".join(c for c in text.lower() if c.isalnum() or c in "@+").translate(_FOLD)
    return out.replace("rl", "n").replace("ll", "u").replace("rn", "m").replace("vv", "w")


def gold_labels(lines: list[str], clean: str) -> list[int]:
    """Labels of scanned lines from the true text: lines of it are body, others header or number by their form."""
    true = set(re.findall(r"\w+", clean.lower()))
    whole, figures = folded(clean), Counter(x.strip() for x in clean.split("\n"))
    out = []
    for line in lines:
        s = " ".join(line.split())
        if not s:
            out.append(1)
        elif BARE_NUMBER.match(s):
            out.append(0 if figures[s] > 0 else 3)
            figures[s] -= 1
        elif PAGE_NUMBER.match(s) or ROMAN.match(s):
            out.append(3)
        else:
            own = folded(s.rstrip(BREAK_MARKS))
            near = [w in true for w in re.findall(r"\w+", s.lower())]
            out.append(0 if own[1:-1] in whole or len(own) < 3 or 2 * sum(near) > len(near) + 1 and s[-1:] in ".,;" else 2)
    return out


#: Each lookalike spelled out so that the sign read and the true one become the same, whatever the order of replacement.
SPELLED = {"c": "e", "@": "a", "+": "t", "5": "s", "1": "l", "i": "l", "0": "o", "h": "b", "6": "b", "9": "g", "u": "ll", "n": "rl", "m": "rrl", "w": "vv"}
_SPELL = str.maketrans(SPELLED)
_BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _wrong, _right in LOOKALIKES:
    _BY_FIRST[_wrong[0]].append((_wrong, _right))


def spelled(word: str) -> str:
    """SQL: the folded form of a word."""
    single = [(k, v) for k, v in SPELLED.items() if len(v) == 1]
    out = f"translate({word}, '{''.join(k for k, _ in single)}', '{''.join(v for _, v in single)}')"
    for k, v in SPELLED.items():
        out = f"replace({out}, '{k}', '{v}')" if len(v) > 1 else out
    return out


def misreadings(token: str, word: str) -> int | None:
    """In how many ways characters of ``word`` were misread where ``token`` was read, or None if it can't have been."""
    rows: dict[int, dict[int, frozenset]] = {0: {0: frozenset()}}
    for i in range(len(token)):
        for j, ways in rows.pop(i, {}).items():
            moves = [(i + 1, j + 1, ways)] if word.startswith(token[i], j) else []
            moves += [(i + len(wrong), j + len(right), ways | {(wrong, right)}) for wrong, right in _BY_FIRST.get(token[i], ()) if token.startswith(wrong, i) and word.startswith(right, j)]
            for x, y, k in moves:
                row = rows.setdefault(x, {})
                if y not in row or len(k) < len(row[y]):
                    row[y] = k
    ways = rows.get(len(token), {}).get(len(word))
    return None if ways is None else len(ways)


def readable(token: str) -> bool:
    """Whether a token is long enough to be told for a misreading."""
    return (len(token) > 2 or len(token) > 1 and any(c in "@+0156789" for c in token)) and any(c.isalpha() for c in token)


def true_form(token: str, own: int, candidates: list[tuple[str, int]]) -> tuple[str, int] | None:
    """The most frequent of the candidates (word, count) of which a token that occurs ``own`` times is a misreading."""
    best = None
    if readable(token):
        for w, n in candidates:
            if w == token or n < LEAST_COUNT or best and (n, best[0]) <= (best[1], w):
                continue
            ways = misreadings(token, w)
            if ways and n >= (RARE_RATIO if ways == 1 and own < LEAST_COUNT else REPAIR_RATIO) * max(1, own):
                best = (w, n)
    return best


#: What stands for a line end within a word while words are counted.
_CUT = "\x01"
_BREAK = r"(?<=\p{L})[\-¬­‐‑‒–—]\s*\n\s*(?=\p{Ll})"
_WORD = r"[\p{L}\p{N}@+\x01]+(?:-[\p{L}\p{N}\x01]+)*"


def counted_words(texts: DataFrame) -> DataFrame:
    """(w, n, alone): how often each word or hyphenated compound of (text) occurs, words joined over line ends and parts
    of compounds counted in, and how often not broken over a line end. Bare figures are no words.

    Counted over all texts with map-side combine and written to the shared folder. Null texts count nothing.
    """
    joined = F.regexp_replace(F.lower("text"), _BREAK, _CUT)
    found = texts.where(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all(joined, F.lit(_WORD), F.lit(0))).alias("w"))
    seen = cut(found.groupBy("w").agg(F.count("*").alias("n")).where(~F.col("w").rlike(r"^\p{N}+$")))
    pieces = F.when(F.col("w").contains("-"), F.array_distinct(F.concat(F.array("w"), F.split("w", "-")))).otherwise(F.array("w"))
    cuts = F.when(F.col("w").contains(_CUT) & ~F.col("w").contains("-"), F.col("n")).otherwise(0)
    whole = seen.select(F.explode(pieces).alias("w"), "n").select(F.replace("w", F.lit(_CUT), F.lit("")).alias("w"), "n", cuts.alias("b"))
    sums = whole.where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("b")).alias("alone"))
    out = cut(sums)
    release(seen)
    return out


def known_words(counted: DataFrame) -> DataFrame:
    """(w, alone, true_word) of every counted word: the frequent word it misreads, if any, and how often it, or else that
    word, stands unbroken.

    Words of one folded form meet in one row; those are spellings of one another, at most as many as the lookalikes
    in a word allow, whatever the corpus.
    """
    groups = counted.groupBy(F.expr(spelled("w")).alias("f")).agg(F.collect_list(F.struct("w", "n", "alone")).alias("held")).where((F.size("held") > 1) & (F.array_max("held.n") >= LEAST_COUNT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for held in b["held"].to_pylist():
                candidates = [(x["w"], x["n"]) for x in held]
                alone = {x["w"]: x["alone"] for x in held}
                for x in held:
                    best = true_form(x["w"], x["n"], candidates)
                    if best:
                        out.append({"w": x["w"], "true_word": best[0], "true_alone": alone[best[0]]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("w", pa.string()), ("true_word", pa.string()), ("true_alone", pa.int64())]))

    repairs = groups.select("held").mapInArrow(run, "w string, true_word string, true_alone long")
    return counted.join(repairs, "w", "left").select("w", F.when(F.col("alone") > 0, F.col("alone")).otherwise(F.coalesce("true_alone", F.lit(0))).alias("alone"), "true_word")


class Repairer:
    """Joins and repairs words by the frequent words of a corpus, and labels lines by a model.

    ``words`` holds every word that occurs at least ``least`` times with its count, ``alone`` how often those stand
    unbroken, where that differs. What rarer words could change is left open: it is decided without them and noted in
    ``asked`` and ``breaks``, or taken from ``answers``.
    """

    def __init__(self, words: dict[str, int], model: LineModel, alone: dict[str, int] | None = None, least: int = 1, total: int = 0):
        self.words, self.model, self.alone, self.least = words, model, alone or {}, least
        self.part = max(PART_COUNT, PART_SHARE * total)
        self.folds: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w, n in words.items():
            self.folds[w.translate(_SPELL)].append((w, n))
        self.known: dict[str, tuple[str | None, bool]] = {}
        self.answers: dict[str, tuple[int, str | None]] = {}
        self.asked: set[str] = set()
        self.breaks: list[tuple[str, str, bool, bool]] = []

    def looked_up(self, token: str) -> tuple[str | None, bool]:
        """The frequent word of which a lower-case token is a misreading, if any, and whether that is certain."""
        found = self.known.get(token)
        if found is None:
            candidates, own = self.folds.get(token.translate(_SPELL), ()), self.words.get(token, 0)
            sure = bool(own) or self.least <= 1 or not readable(token)
            best = true_form(token, own, candidates)
            if not sure and best:  # the token occurs less than ``least`` times
                sure = true_form(token, max(LEAST_COUNT, self.least - 1), candidates) is not None
            found = (best[0] if best and sure else None, sure)
            if len(self.known) < 500_000:
                self.known[token] = found
        return found

    def true_word(self, token: str) -> str | None:
        true, sure = self.looked_up(token)
        if not sure:
            if token in self.answers:
                return self.answers[token][1]
            self.asked.add(token)
        return true

    def misread(self, text: str) -> bool:
        if "<" in text:
            text = _TAG.sub(" ", text)  # what stands in a tag is no content
        known = self.known
        for t in set(TOKEN.findall(text.lower())):
            true, sure = known.get(t) or self.looked_up(t)
            if true or not sure and self.true_word(t):
                return True
        return False

    def fixed(self, text: str) -> str:
        def fix(m: re.Match) -> str:
            true = self.true_word(m[0].lower())
            if not true:
                return m[0]
            return true.upper() if len(m[0]) > 1 and m[0].isupper() else true[0].upper() + true[1:] if m[0][0].isupper() else true

        return TOKEN.sub(fix, text)

    def count(self, word: str) -> int:
        """How often a word, or else the word it misreads, stands unbroken."""
        if word in self.answers:
            return self.answers[word][0]
        own = self.alone.get(word, self.words.get(word, 0))
        true = None if own else self.looked_up(word)[0]
        return own or (self.alone.get(true, self.words.get(true, 0)) if true else 0)

    def broken(self, left: str, mark: str, right: str) -> bool:
        """Whether a word is broken between two lines, rather than a compound at its own hyphen."""
        a, b = left.lower(), right.lower()
        joined, hyphened = a.rpartition("-")[2] + b, f"{a}-{b}"
        whole, compound, hyphen = self.count(joined), self.count(hyphened), mark in "-‐‑"
        # neither is known: two known words make a compound, fragments a broken word
        part_a, part_b = self.words.get(a.rpartition("-")[2], 0), self.words.get(b, 0)
        unknown = not (mark in "–—−" and not right[:1].islower()) and not (mark == "-" and len(a) > 2 and len(b) > 2 and part_a > self.part and part_b > self.part)
        if self.least > 1 and max(whole, compound) < self.least and joined not in self.answers:
            self.breaks.append((joined, hyphened, hyphen, unknown))
        return not (hyphen and compound > whole) and (whole > 0 or unknown)

    def read(self, text: str, page: int | None, repair: bool = True) -> tuple[list[str], str]:
        """Defects of a text, and the text put together, with its misread words repaired where ``repair`` is set."""
        if "\n" not in text and "\r" not in text:
            return (["misread"] if self.misread(text) else []), self.fixed(text.strip()) if repair else text
        lines = lines_of(text)
        labels = self.model.labels(line_features(lines, page))
        plain = [" ".join(x.split()) for x in lines]
        labels = [1 if not s else 0 if label == 1 else label for s, label in zip(plain, labels)]
        defects = set()
        if 2 in labels:
            defects.add("header")
        if 3 in labels:
            defects.add("page_number")
        kept: list[str] = []  # paragraphs
        held, gap, cut_here = "", False, False
        figures = False
        for s, label in zip(plain, labels):
            if label in (2, 3):
                cut_here = True
                continue
            if label == 1:
                gap = True
                continue
            mark = held[-1:] in _MARKS and BREAK_END.search(held, max(0, len(held) - 80))
            broken = mark if not gap else None
            if mark and gap and cut_here and s[:1].islower():
                broken, gap = mark, False
            if held and gap and cut_here and held[-1] not in ".?!:)]" and s[:1].islower():
                gap = False  # a sentence runs on behind what stood between
            listed = bool(BARE_NUMBER.match(s))
            if not held:
                held = s
            elif gap:
                kept.append(held)
                held = s
            elif broken and (head := HEAD_WORD.match(s)) and head[0][0].isalpha():
                still_open = len(self.breaks)
                if self.broken(broken[1], broken[2], head[0]):
                    if len(self.breaks) == still_open:
                        defects.add("hyphen")
                    held = held[: broken.start(2)] + s
                else:
                    held = held[: broken.start(2)] + "-" + s
            elif listed or figures:
                held += "\n" + s
            else:
                held += " " + s
            gap = cut_here = False
            figures = listed or s[-1] == ":" and len(s.split()) < 3 and held == s  # a line that announces what follows
        if held:
            kept.append(held)
        body = "\n\n".join(kept)
        if self.misread(body):
            defects.add("misread")
        return sorted(defects), self.fixed(body) if repair else body


def fitted_model(notes: DataFrame, transcripts: DataFrame, most: int = MOST_TRANSCRIPTS, most_chars: int = MOST_CHARS) -> LineModel:
    """The line model fitted on at most ``most`` notes of at most ``most_chars`` characters with a transcript; without any,
    every line is body or break."""
    known = transcripts.where("note_id is not null and clean_text is not null").groupBy("note_id").agg(F.min("clean_text").alias("clean_text")).orderBy(F.xxhash64("note_id"), "note_id").limit(most)
    rows = notes.where("text is not null").where(F.length("text") <= most_chars).select(F.col("id").alias("note_id"), "text", "page").join(F.broadcast(known), "note_id").collect()
    examples = []
    for r in sorted(rows, key=lambda r: r["note_id"]):
        lines = lines_of(r["text"])
        examples.append((line_features(lines, r["page"]), gold_labels(lines, r["clean_text"])))
    return LineModel().fit(examples)


def _records(questions: DataFrame, notes: DataFrame) -> DataFrame:
    own = lambda df, name: df.where("id is not null and text <> ''").select(F.lit(name).alias("source_table"), F.col("id").cast("int").alias("record_id"), F.col("page").cast("int").alias("page"), "text")
    return all_cores(own(questions, "questions")).unionByName(all_cores(own(notes, "notes")))


FIRST = "source_table string, record_id int, page int, text string, defects array<string>, asked array<string>, breaks array<struct<joined: string, hyphened: string, hyphen: boolean, unknown: boolean>>, clean_text string"


class Corpus:
    """The words of the texts and the fitted model: what all records are read by."""

    def __init__(self, rows: DataFrame, notes: DataFrame, transcripts: DataFrame, share: float, most_transcripts: int, most_chars: int):
        self.counted = counted_words(rows.select("text"))
        total = self.counted.agg(F.sum("n")).first()[0] or 0
        self.least = max(1, math.ceil(total * share))
        frequent = self.counted.where(F.col("n") >= self.least).toArrow()  # at most 1/share words
        names, n, alone = (frequent[c].to_pylist() for c in ("w", "n", "alone"))
        self.words, self.alone, self.total = dict(zip(names, n)), {w: x for w, x, y in zip(names, alone, n) if x != y}, total
        self.model = fitted_model(notes, transcripts, most_transcripts, most_chars)

    def read(self, rows: DataFrame, texts: bool) -> DataFrame:
        """Rows (source_table, record_id, page, text) as FIRST; with a column ``answers`` those are used and nothing is asked."""
        words, alone, least, total, model = self.words, self.alone, self.least, self.total, self.model
        answered = "answers" in rows.columns
        schema = FIRST if not answered else "source_table string, record_id int, defects array<string>, clean_text string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Repairer(words, model, alone, least, total)
            for b in batches:
                found = []
                answers = b["answers"].to_pylist() if answered else [None] * b.num_rows
                for text, page, known in zip(b["text"].to_pylist(), b["page"].to_pylist(), answers):
                    reader.asked, reader.breaks, reader.answers = set(), [], {x["w"]: (x["alone"], x["true_word"]) for x in known or ()}
                    defects, clean = reader.read(text, page, texts)
                    found.append((defects, sorted(reader.asked), reader.breaks, clean))
                defects, clean = pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[3] if texts else None for f in found], pa.string())
                if answered:
                    yield pa.RecordBatch.from_arrays([b["source_table"], b["record_id"], defects, clean], names=["source_table", "record_id", "defects", "clean_text"])
                    continue
                kind = pa.struct([("joined", pa.string()), ("hyphened", pa.string()), ("hyphen", pa.bool_()), ("unknown", pa.bool_())])
                breaks = pa.array([[dict(zip(("joined", "hyphened", "hyphen", "unknown"), x)) for x in f[2]] for f in found], pa.list_(kind))
                page, text = (b["page"], b["text"]) if texts else (pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.string()))
                yield pa.RecordBatch.from_arrays([b["source_table"], b["record_id"], page, text, defects, pa.array([f[1] for f in found], pa.list_(pa.string())), breaks, clean], names=["source_table", "record_id", "page", "text", "defects", "asked", "breaks", "clean_text"])

        return rows.mapInArrow(run, schema)


def repaired(questions: DataFrame, notes: DataFrame, transcripts: DataFrame, share: float = WORD_SHARE, most_transcripts: int = MOST_TRANSCRIPTS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(source_table, record_id, defects, clean_text) of every record with a text.

    defects holds, sorted, ``header`` and ``page_number`` (a line so labelled stands in the text), ``hyphen`` (a word
    broken over a line end that isn't a compound at its own hyphen) and ``misread`` (a word of the body is a frequent
    word with lookalike characters). Null and empty texts have no row. A null page only means that a bare figure isn't
    held against it. Texts of any length are read whole. Records that depend on rare words are read again with what the
    full table of words has on them. ``most_transcripts`` and ``most_chars`` bound the sample the line model is fitted on.
    """
    corpus = Corpus(rows := _records(questions, notes), notes, transcripts, share, most_transcripts, most_chars)
    first = cut(corpus.read(rows, True))
    open_words = F.array_distinct(F.concat("asked", F.flatten(F.transform("breaks", lambda x: F.array(x["joined"], x["hyphened"])))))
    record = ["source_table", "record_id", "page", "text"]
    asked = first.where("size(asked) > 0 or size(breaks) > 0").select(*record, open_words.alias("asked"))
    numbered = asked.select(F.xxhash64(*record).alias("key"), F.explode("asked").alias("w"))  # equal records ask the same
    met = numbered.distinct().join(known_words(corpus.counted), "w").groupBy("key").agg(F.collect_list(F.struct("w", "alone", "true_word")).alias("answers"))
    none = F.array().cast("array<struct<w: string, alone: bigint, true_word: string>>")
    unknown = lambda have: F.transform(F.array_except("asked", F.transform(have, lambda x: x["w"])), lambda w: F.struct(w.alias("w"), F.lit(0).cast("bigint").alias("alone"), F.lit(None).cast("string").alias("true_word")))
    again = asked.withColumn("key", F.xxhash64(*record)).join(met, "key", "left").withColumn("answers", F.coalesce("answers", none))
    again = again.select(*record, F.concat("answers", unknown(F.col("answers"))).alias("answers"))
    done = first.where("size(asked) = 0 and size(breaks) = 0").select("source_table", "record_id", "defects", "clean_text")
    return done.unionByName(corpus.read(again, True))


def defects_found(questions: DataFrame, notes: DataFrame, transcripts: DataFrame, share: float = WORD_SHARE, most_transcripts: int = MOST_TRANSCRIPTS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(source_table, record_id, defect): one row for each defect of each record, as ``repaired`` has them.

    No text is read twice: what depends on rare words is decided by joins with the full table of words.
    """
    corpus = Corpus(rows := _records(questions, notes), notes, transcripts, share, most_transcripts, most_chars)
    first = cut(corpus.read(rows, False).drop("page", "text", "clean_text"))
    known = known_words(corpus.counted)
    misread = first.where("not array_contains(defects, 'misread')").select("source_table", "record_id", F.explode("asked").alias("w")).join(known.where("true_word is not null").select("w"), "w").select("source_table", "record_id", F.lit("misread").alias("defect"))
    breaks = first.where("not array_contains(defects, 'hyphen')").select("source_table", "record_id", F.explode("breaks").alias("x")).select("source_table", "record_id", "x.*")
    alone = lambda name: known.select(F.col("w").alias(name), F.col("alone").alias(f"{name}_n"))
    counts = breaks.join(alone("joined"), "joined", "left").join(alone("hyphened"), "hyphened", "left").fillna(0, ["joined_n", "hyphened_n"])
    hyphen = counts.where("not (hyphen and hyphened_n > joined_n) and (joined_n > 0 or unknown)").select("source_table", "record_id", F.lit("hyphen").alias("defect"))
    return first.select("source_table", "record_id", F.explode("defects").alias("defect")).unionByName(misread).unionByName(hyphen).distinct()
