"""Personal data by exact base patterns and a semi-Markov random field.

The base patterns are fixed (see BASE) and always stay.  The text between base
spans is cut into tokens, and every candidate segment of up to MOST_TOKENS
tokens is scored as a whole: its shape, digit groups, separators, checksum and
the words before it.  Dynamic programming over the tokens picks boundaries and
types jointly; a token outside a segment scores nothing.  A candidate holds
four digits or an at-mark, so only tokens from which MOST_TOKENS tokens reach
these begin one; the others have no candidate, and skipping them changes no
result.  Candidates are scored in blocks of SCORED first tokens, so memory is
bounded by a text's tokens and time grows with its length, long runs of digits
and tables of numbers included.

The field is trained with numpy on the driver, by the exact gradient of the
segment likelihood, on spellings made by a seeded generator; it needs no row
of the corpus.  Null texts count as empty; repeated rows get equal spans;
every row is handled on its own and whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import map_frames, read_table, slices, tidied

KINDS = ("email", "ip", "card", "phone")
#: The base patterns by kind.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MOST_TOKENS = 24
SCORED = 2048
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, " + ", ".join(f"n_all_{k} long" for k in KINDS)
Span = tuple[int, int, str]

#: All ip, card and phone matches lie in such a run, all email matches in a run around an at-sign.
_NUMBERS = re.compile(r"\+?[0-9][0-9 ().+-]*")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The base patterns with the same matches in linear time: a run of digits is tried from its first digit only, as a
#: later one can match only where the first does, and what repeats gives nothing back.
_QUICK = BASE | {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++")}
#: What any candidate holds one of: a number, an at-sign or the word at. One set of first characters makes the scan fast.
_SEED = re.compile(r"[0-9@aA](?:(?<=[0-9])[0-9]*|(?<=@)|(?<=[aA])[tT](?<![^\W\d_][aA][tT])(?![^\W\d_]))")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    digits = re.sub("[^0-9]", "", s)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    """The email pattern's matches, at-sign by at-sign: each looks at its own run of name characters only."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > done and (c := text[left - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            left -= 1
        m = _HOST.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of every kind that pass its check, in order of kind and start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = _emails(text)
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        for kind in KINDS[1:]:
            for m in _QUICK[kind].finditer(text, run.start(), run.end()):
                if _valid(kind, m[0]):
                    found[kind].append((m.start(), m.end(), kind))
    return [s for k in KINDS for s in found[k]]


def gaps(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Ranges outside the taken spans."""
    out, at = [], 0
    for a, b in sorted((a, b) for a, b, _ in taken):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, len(text))] if at < len(text) else out


_WORDS = {"phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "fon"}, "card": {"card", "visa", "iban", "karte", "tarjeta", "carte"}, "ip": {"ip", "host", "server", "address"}, "email": {"mail", "email", "contact", "write"}}
NAMES = (
    ["bias", "tokens", "has_letters", "outer_space", "digits_4_9", "digits_10_11", "digits_12_15", "digits_16_19", "digits_20", "luhn16", "groups_1", "groups_2", "groups_3", "groups_4", "groups_5"]
    + ["four_octets", "even_groups", "ends_4", "group_333_4", "plus", "brackets", "dots", "dashes", "spaces", "colon_slash", "comma_money", "other_marks", "at_sign", "at_word", "dot_word", "dot_after_at", "long_tail", "digit_neighbour", "letter_neighbour", "line_break", "words_3", "mixed_separators", "sentence_end", "one_host"]
    + ["near_" + k for k in KINDS]
)
FEATURES = len(NAMES)


_CLASSES = [
    ("letter", lambda t: t[0].isalpha()), ("digit", lambda t: t[0] in "0123456789"), ("space", str.isspace), ("alnum", lambda t: t[0].isalnum()),
    ("at", lambda t: t == "@"), ("at_word", lambda t: t.lower() == "at"), ("dot_word", lambda t: t.lower() == "dot"), ("dot", lambda t: t == "."), ("dash", lambda t: t == "-"),
    ("open", lambda t: t == "("), ("close", lambda t: t == ")"), ("colon_slash", lambda t: t in ":/"), ("comma_money", lambda t: t in ",$€"),
    ("other", lambda t: not t[0].isalnum() and not t.isspace() and t not in "+()[]{}<>.-_@:/,$€"), ("newline", lambda t: "\n" in t), ("plus", lambda t: t == "+"), ("opening", lambda t: t in "+(["),
    ("bracket", lambda t: t in "()[]{}<>"), ("stop", lambda t: t in ".!?"), ("tail", lambda t: 2 <= len(t) <= 4 and t.isalpha() and t.lower() not in ("at", "dot")),
    ("tied_left", lambda t: t[0] in "0123456789.-:/$#"), ("tied_right", lambda t: t[0] in "0123456789-:/%"), ("ends", lambda t: t.isspace() or t[0] in ".,;)"), ("octet", lambda t: t[0] in "0123456789" and len(t) <= 3 and int(t) <= 255),
    *((("near_" + k), lambda t, k=k: t.lower() in _WORDS[k]) for k in KINDS),
]
_BIT = {name: 1 << k for k, (name, _) in enumerate(_CLASSES)}
_MEMO, LONG = 200_000, 256
CONTEXT = 4
APART = MOST_TOKENS + CONTEXT
_classes: dict[str, int] = {}


def _class(token: str) -> int:
    """The token's classes as bits, and above them a number that tells separators apart."""
    bits = sum(_BIT[name] for name, f in _CLASSES if f(token))
    return bits | ((zlib.crc32(token.encode("utf-8", "replace")) >> 2 | 1) << 32 if not token.isalnum() else 0)


class Tokens:
    """Classes, lengths and digits of the tokens of many stretches of text, as arrays.

    Stretches are parted by blank tokens of no length, so many that no candidate
    and no context reaches from one into the next.
    """

    def __init__(self, stretches: list[list[str]]):
        words = [w for s in stretches for w in s]
        if len(_classes) > _MEMO:
            _classes.clear()
        known, new = _classes, {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= LONG else new)[w] = _class(w)
        lookup = known | new if new else known
        counts = np.array([len(s) for s in stretches], np.int64)
        self.first = np.cumsum(counts + APART) - counts  # each stretch's first token
        inside = np.repeat(self.first - np.cumsum(counts) + counts, counts) + np.arange(len(words))
        kind = np.full(int(counts.sum()) + APART * (len(stretches) + 1), lookup.get(" ", _class(" ")), np.int64)
        size = np.zeros(len(kind), np.int64)
        kind[inside] = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
        size[inside] = np.fromiter(map(len, words), np.int64, len(words))
        digits = [w for w in words if w[0] in "0123456789"]
        self.n, self.kind = len(kind), kind
        self.end = np.cumsum(size)
        number = kind & _BIT["digit"] > 0
        self.digits = np.where(number, size, 0)
        self.digits_before = np.concatenate([[0], np.cumsum(self.digits)])
        value = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice = np.where(value > 4, 2 * value - 9, 2 * value)
        even = np.arange(len(value)) % 2 == 0
        self.luhn = [np.concatenate([[0], np.cumsum(np.where(even == (k == 0), twice, value))]) for k in (0, 1)]
        group = np.concatenate([np.zeros(3, np.int64), size[number]])
        last = np.cumsum(number) + 2
        self.group = [group[np.maximum(last - k, 0)] for k in range(3)]  # lengths of the last three numbers up to a token
        name, place = kind >> 32, np.arange(len(kind))
        order = np.argsort(name, kind="stable")
        self.same = np.full(len(kind), -1, np.int64)  # the place of the last equal separator
        again = name[order][1:] == name[order][:-1]
        self.same[order[1:][again]] = place[order[:-1][again]]

    def starts(self) -> np.ndarray:
        """Tokens that may begin a candidate: words, numbers and opening signs from which enough digits or an at-mark are in reach."""
        reach = np.minimum(np.arange(self.n) + MOST_TOKENS, self.n)
        marks = np.concatenate([[0], np.cumsum(self.kind & (_BIT["at"] | _BIT["at_word"]) > 0)])
        near = (self.digits_before[reach] - self.digits_before[:-1] >= 4) | (marks[reach] > marks[:-1])
        return np.flatnonzero(near & (self.kind & (_BIT["alnum"] | _BIT["opening"]) > 0))

    def candidates(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, end, features) of the candidates that begin at these tokens.

        A candidate starts and ends on a word, number or opening sign, has
        MOST_TOKENS tokens at most, and holds four digits or an at-mark.
        """
        column = np.arange(MOST_TOKENS)
        at = start[:, None] + column
        valid = at < self.n
        at = np.minimum(at, self.n - 1)
        kind = np.where(valid, self.kind[at], 0)
        has = lambda *names: kind & sum(_BIT[n] for n in names) > 0
        some = lambda x: np.logical_or.accumulate(x, axis=1)
        digit_len = np.where(valid, self.digits[at], 0)
        n = np.cumsum(digit_len, axis=1)
        marked = some(has("at", "at_word"))
        broken = some(has("newline") & (column > 0) & (n > 30))
        row, col = np.nonzero(has("alnum") & valid & ~broken & ((((n >= 4) | marked & (column >= 4)) & (column > 0)) | (n >= 8)))
        if not len(row):
            return start[:0], start[:0], np.zeros((0, FEATURES))
        pick = lambda x: x[row, col]
        first, last = start[row], start[row] + col
        letters, groups, total = np.cumsum(has("letter"), axis=1), np.cumsum(has("digit"), axis=1), pick(n)
        g = pick(groups)
        f = dict.fromkeys(NAMES)
        f["bias"], f["tokens"] = np.ones(len(row)), (col + 1) / 10
        f["digits_4_9"], f["digits_10_11"], f["digits_12_15"], f["digits_16_19"], f["digits_20"] = (total >= 4) & (total <= 9), (total == 10) | (total == 11), (total >= 12) & (total <= 15), (total >= 16) & (total <= 19), total >= 20
        p = self.digits_before[first]
        q = p + total
        f["luhn16"] = f["digits_16_19"] & (np.where(q % 2 == 0, self.luhn[0][q] - self.luhn[0][p], self.luhn[1][q] - self.luhn[1][p]) % 10 == 0)
        for k in range(1, 6):
            f[f"groups_{k}"] = np.clip(g, 1, 5) == k
        f["four_octets"] = (g == 4) & (pick(np.cumsum(has("octet"), axis=1)) == 4)
        large = np.iinfo(np.int64).max
        f["even_groups"] = (g > 2) & (pick(np.minimum.accumulate(np.where(has("digit"), digit_len, large), axis=1)) == pick(np.maximum.accumulate(digit_len, axis=1)))
        f["ends_4"] = (g > 0) & (self.group[0][last] == 4)
        f["group_333_4"] = (g > 2) & (self.group[0][last] == 4) & (self.group[1][last] == 3) & (self.group[2][last] == 3)
        f["plus"] = self.kind[first] & _BIT["plus"] > 0
        f["brackets"] = pick(some(has("open")) & some(has("close")))
        f["dots"], f["dashes"], f["colon_slash"], f["comma_money"], f["other_marks"] = (pick(some(has(k))) for k in ("dot", "dash", "colon_slash", "comma_money", "other"))
        f["spaces"], f["line_break"] = pick(some(has("space"))), pick(some(has("newline")))
        f["mixed_separators"] = pick(np.cumsum((kind >> 32 != 0) & (np.where(valid, self.same[at], large) < start[:, None]), axis=1)) > 2
        f["has_letters"], f["words_3"] = pick(letters) > 0, pick(letters) > 4
        sign, word = (np.where((x := has(k)).any(1), x.argmax(1), MOST_TOKENS) for k in ("at", "at_word"))  # first places
        f["at_sign"] = sign[row] <= col
        f["at_word"] = (word[row] <= col) & (word[row] > 0)
        pos = np.where(f["at_sign"], sign[row], np.where(word[row] <= col, word[row], -1))
        f["dot_word"] = pick(some(has("dot_word")))
        f["dot_after_at"] = (pos > 0) & (pick(np.maximum.accumulate(np.where(has("dot", "dot_word"), column, -1), axis=1)) >= pos)
        f["long_tail"] = f["has_letters"] & (pos > 0) & pick(has("tail"))
        ended = np.zeros(kind.shape, bool)
        ended[:, 2:] = some(has("stop")[:, 1:-1] & ~has("space")[:, :-2] & has("space")[:, 2:])
        f["sentence_end"] = pick(ended)
        hosts = []
        for mark in (sign, word):  # one word between the at-mark and the first dot, spelt out or not
            plain = valid & ~has("space", "bracket") & (column > mark[:, None])
            rank = np.cumsum(plain, axis=1)
            fits = (plain & (rank == 1) & has("alnum")).any(1) & (plain & (rank == 2) & has("dot", "dot_word")).any(1)
            hosts.append(fits[row] & (pick(rank) > 2))
        f["one_host"] = (pos > 0) & np.where(f["at_sign"], *hosts)
        blank = _BIT["space"] | _BIT["ends"]
        before = np.where(first > 0, self.kind[first - 1], blank)
        after = np.where(last + 1 < self.n, self.kind[np.minimum(last + 1, self.n - 1)], blank)
        f["digit_neighbour"] = (before & _BIT["tied_left"] > 0) | (after & _BIT["tied_right"] > 0)
        f["letter_neighbour"] = (before | after) & _BIT["letter"] > 0
        f["outer_space"] = (before & _BIT["space"] > 0) & (after & _BIT["ends"] > 0)
        near = np.zeros(len(start), np.int64)
        for k in range(1, CONTEXT + 1):
            near |= np.where(start >= k, self.kind[np.maximum(start - k, 0)], 0)
        for k in KINDS:
            f["near_" + k] = near[row] & _BIT["near_" + k] > 0
        return first, last + 1, np.stack([f[k] for k in NAMES], axis=1).astype(float)


class Field:
    """Weights of every type's segment features, KINDS x FEATURES."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def decode(self, tokens: Tokens) -> list[tuple[int, int, str]]:
        """The best segmentation: (first token, end, type)."""
        found = []
        starts = tokens.starts()
        for at in range(0, len(starts), SCORED):
            first, end, f = tokens.candidates(starts[at : at + SCORED])
            scores = f @ self.weights.T
            kind = scores.argmax(1)
            top = scores[np.arange(len(kind)), kind]
            good = np.flatnonzero(top > 0)  # a segment that scores nothing improves no segmentation
            found.append((first[good], end[good], top[good], kind[good]))
        if not any(len(x[0]) for x in found):
            return []
        first, end, top, kind = (np.concatenate(x) for x in zip(*found))
        # Dynamic program over the places where a candidate ends: the best sum up to each.
        order = np.lexsort((first, end))
        ends, best, back = [0], [0.0], [-1]
        for c in order.tolist():
            i, j = int(first[c]), int(end[c])
            before = bisect.bisect_right(ends, i) - 1
            value = best[before] + float(top[c])
            if value > best[-1]:
                if ends[-1] == j:
                    best[-1], back[-1] = value, c
                else:
                    ends.append(j)
                    best.append(value)
                    back.append(c)
        out, k = [], len(ends) - 1
        while k > 0:
            c = back[k]
            out.append((int(first[c]), int(end[c]), KINDS[kind[c]]))
            k = bisect.bisect_right(ends, int(first[c])) - 1
        return out[::-1]


def _gradient(weights: np.ndarray, n: int, spans: list[tuple[int, int]], f: np.ndarray, gold: set) -> np.ndarray:
    """Gradient of the log likelihood of the gold segments of n tokens by forward and backward sums over segments."""
    scores = np.clip(f @ weights.T, -30, 30)
    each = np.logaddexp.reduce(scores, axis=1)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for c, (i, j) in enumerate(spans):
        by_end.setdefault(j, []).append(c)
        by_start.setdefault(i, []).append(c)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[spans[c][0]] + each[c] for c in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[spans[c][1]] + each[c] for c in by_start.get(i, ()))])
    outer = np.array([forward[i] + backward[j] for i, j in spans]) - forward[n]
    p = np.exp(outer[:, None] + scores)
    for c, (i, j) in enumerate(spans):
        for k, kind in enumerate(KINDS):
            p[c, k] = ((i, j, kind) in gold) - p[c, k]
    return p.T @ f


def _spellings(rng: np.random.Generator) -> tuple[str, str | None]:
    """One made-up passage: its text and its type, or None for what isn't personal."""
    r = lambda a, b: int(rng.integers(a, b))
    pick = lambda *x: x[r(0, len(x))]
    word = lambda: "".join(chr(97 + r(0, 26)) for _ in range(r(3, 9)))
    number = lambda n: "".join(str(r(0, 10)) for _ in range(n))
    kind = pick("email", "ip", "card", "phone", None, None, None, "prose")
    if kind == "prose":  # sentences around an at
        some = lambda: pick("", f" {word()}", f" {word()} {word()}", f", {word()}")
        return f"{word()}{some()}{pick('', ',', '.')}{pick(' ', chr(10))}{pick('at', 'at', 'At')}{some()}{pick('.', '.', '.', '!', '?')}{pick(' ', ' ', chr(10))}{pick(word(), word()[:3], word()[:2]).capitalize()}{some()}", None
    if kind == "email":
        name = word() + pick("", "." + word(), number(2), "".join(pick(".", ".", "-", "_") + word() for _ in range(r(1, 4))))
        host, tail = word(), pick("com", "org", "net", "de")
        return name + pick(f" at {host} dot {tail}", f" (at) {host} (dot) {tail}", f"(at){host}.{tail}", f" [at] {host} [dot] {tail}", f" @ {host}.{tail}", f" @ {host} . {tail}", f" at {host}.{tail}"), kind
    if kind == "ip":
        return pick(" . ", "[.]", "(.)", " .").join(str(r(0, 256)) for _ in range(4)), kind
    if kind == "card":
        while not luhn(s := "4" + number(15)):
            pass
        return pick(".", "  ", " - ", "_", "/").join(s[k : k + 4] for k in range(0, 16, 4)), kind
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"+ {r(1, 99)} {a} {b} {c}"), kind
    return pick(number(r(4, 13)), f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 29):02}.{r(1, 13):02}.{r(1900, 2100)}", f"{r(0, 24)}:{r(0, 60):02}:{r(0, 60):02}", f"${r(1, 999)},{number(3)}.{number(2)}", f"v{r(0, 9)}.{r(0, 30)}.{number(4)}", "".join(pick(*"0123456789abcdef") for _ in range(r(12, 40))), number(20) + number(r(1, 20)), f"{word()} at {word()} {number(4)}", f"{number(4)} {word()} {number(4)} {word()}", f"{number(4)}-{number(4)}", f"{number(2)}/{number(5)}", number(16), f"@{word()}", f"{word()} at {word()}", f"http://{word()}.com/{number(6)}", f"{number(3)} {number(3)} {number(3)} {number(3)} {number(3)} {number(3)} {number(3)}"), None


@lru_cache(maxsize=4)
def trained(examples: int = 500, epochs: int = 8, seed: int = 3) -> Field:
    rng = np.random.default_rng(seed)
    filler = lambda k: [("".join(chr(97 + int(rng.integers(0, 26))) for _ in range(int(rng.integers(2, 9))))) for _ in range(k)]
    data = []
    for _ in range(examples):
        left, right = filler(int(rng.integers(1, 4))), filler(int(rng.integers(1, 4)))
        body, kind = _spellings(rng)
        if kind and rng.random() < 0.3:
            left.append(sorted(_WORDS[kind])[int(rng.integers(0, len(_WORDS[kind])))])
        head = " ".join(left) + " "
        text = head + body + (". " if rng.random() < 0.2 else " ") + " ".join(right)
        tokens = Tokens([_TOKEN.findall(text)])
        place = lambda x: int(np.searchsorted(tokens.end[APART:], x, "right")) + APART
        gold = {(place(len(head)), place(len(head) + len(body)), kind)} if kind else set()
        first, end, f = tokens.candidates(tokens.starts())
        if len(first):
            data.append((tokens.n, list(zip(first.tolist(), end.tolist())), f, gold))
    weights, seen = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-2)
    weights[:, 0] = -3
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            g = _gradient(weights, *data[k]) - 1e-3 * weights
            seen += g * g
            weights += 0.4 * g / np.sqrt(seen)
    return Field(weights)


def _left(text: str, low: int, at: int) -> tuple[int, list[str]]:
    """(start, tokens) of text before at: as many tokens as a candidate and its context can reach, or all from low."""
    width = 128
    while True:
        start = max(low, at - width)
        words = _TOKEN.findall(text, start, at)
        if start == low:
            return start, words
        if len(words) > APART:  # the first may be cut
            words = words[-APART:]
            return at - sum(map(len, words)), words
        width *= 2


def _right(text: str, at: int, high: int) -> tuple[int, list[str]]:
    """(end, tokens) of text from at on, likewise."""
    width = 128
    while True:
        stop = min(high, at + width)
        words = _TOKEN.findall(text, at, stop)
        if stop == high:
            return stop, words
        if len(words) > APART:
            words = words[:APART]
            return at + sum(map(len, words)), words
        width *= 2


def stretches(text: str, low: int, high: int) -> list[tuple[int, list[str]]]:
    """(start, tokens) of the parts of text[low:high] in which all candidates and their contexts lie."""
    near: list[list[int]] = []
    for seed in _SEED.finditer(text, low, high):
        if near and seed.start() - near[-1][1] <= APART:  # so few characters are no more tokens
            near[-1][1] = seed.end()
        else:
            near.append([seed.start(), seed.end()])
    out: list[tuple[int, list[str]]] = []
    end = low - 1  # of the last stretch
    for a, b in near:
        start, before = _left(text, low, a)
        stop, after = _right(text, b, high)
        if out and start <= end:
            out[-1][1].extend(_TOKEN.findall(text, end, stop))
        else:
            out.append((start, [*before, *_TOKEN.findall(text, a, b), *after]))
        end = max(end, stop)
    return out


def find_all(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and the spans that the field adds, for each text."""
    out: list[tuple[list[Span], list[Span]]] = []
    parts, where = [], []
    for k, text in enumerate(texts):
        base = base_spans(text) if isinstance(text, str) else []
        out.append((base, []))
        for a, b in gaps(text, base) if isinstance(text, str) else ():
            for start, words in stretches(text, a, b):
                parts.append(words)
                where.append((k, start, a, b))
    if not parts:
        return out
    tokens = Tokens(parts)
    for i, j, kind in field.decode(tokens):
        r = bisect.bisect_right(tokens.first, i) - 1
        k, start, a, b = where[r]
        text, shift = texts[k], start - int(tokens.end[tokens.first[r] - 1])
        i, j = int(tokens.end[i - 1]) + shift, int(tokens.end[j - 1]) + shift
        # whole tokens only: a base span's edge may cut one
        if (i > a or a == 0 or not text[a - 1].isalnum()) and (j < b or b == len(text) or not text[b].isalnum()):
            out[k][1].append((i, j, kind))
    return out


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that the field adds."""
    return find_all([text], field)[0]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0])))


def redact(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its type in angle brackets; overlapping spans make one."""
    out, at, end = [], 0, -1
    for a, b, k in sorted(spans):
        if a >= end:
            out += [text[at:a], f"<{k.upper()}>"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """The digest of every document's spans (see the registered query's columns)."""
    field = trained()

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, (base, added) in zip(b["doc_id"], find_all(b["text"].tolist(), field)):
                n = [sum(s[2] == k for s in base) for k in KINDS]
                every = [sum(s[2] == k for s in base + added) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), *every))
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, OUT)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the text where it is a column."""
    field = trained()
    counted = "n_chars" in docs.columns

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            texts = []
            old = b.column("text").to_pylist()
            for t, (base, added) in zip(old, find_all(old, field)):
                texts.append(redact(t, base + added) if base or added else t)
            new = {"text": pa.array(texts, b.schema.field("text").type)}
            if counted:
                old = b.column("n_chars")
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], schema=b.schema)

    return docs.mapInArrow(lambda batches: tidied(run(batches)), docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))
