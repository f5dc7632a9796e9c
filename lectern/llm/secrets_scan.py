"""Secret scans: pattern matches, and guess costs of values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, as a greedy match of any length followed by a test of its length would give.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A keyword anywhere in a name, with the rest of the name: clientSecret, SECRET_KEY.
NAME = re.compile(
    r"""(?:passw(?:ord|d)|passphrase|pwd|secret|token|credential|(?:api|access|private|auth|signing|encryption)[_-]?key)[A-Za-z0-9_-]*+""",
    re.IGNORECASE | re.ASCII,
)
SIGN = re.compile(r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*""")
VALUE = re.compile(r""""([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;)\]}]+)""", re.ASCII)
#: A text without any of these (in lower case) has no assignment and no credential context.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "credential", "key")
KINDS = ("assign", "access", "hex", "guess")

MIN_VALUE = 6
#: Values that take at least ten to this many guesses count as secrets of their own.
MIN_LOG10_GUESSES = 10.0

# Words that passwords are made of, the commonest first.
COMMON_WORDS = """
password admin welcome login master dragon monkey qwerty letmein football baseball sunshine princess shadow
superman michael jordan killer soccer hockey hunter ranger buster tigger charlie robert thomas jennifer jessica
pepper cookie summer winter spring autumn secret access token test example sample demo user root guest default
change changeme please enter your here insert placeholder dummy none null undefined true false hello world love
money freedom whatever computer internet server database mysql oracle system windows linux apple google
january february march april june july august september october november december monday friday sunday
the and for you not are was with that this from have pass word key api prod dev staging local host service
""".split()

# Rows of the usual keyboard and key pad.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
KEYPAD = ("789", "456", "123", "0")

_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_LONGEST = max(map(len, COMMON_WORDS))
_LEET = str.maketrans("@4310$5!7", "aaeiossit")


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for rows, slant in ((KEYBOARD, True), (KEYPAD, False)):
        at = {c: (x, y) for y, row in enumerate(rows) for x, c in enumerate(row)}
        for c, (x, y) in at.items():
            for d, (u, v) in at.items():
                near = (y == v and abs(x - u) == 1) or (abs(y - v) == 1 and (u - x in ((0, v - y) if not slant else (0, y - v))))
                if near:
                    out.setdefault(c, set()).add(d)
    return out


NEAR = _neighbours()
_YEAR = re.compile(r"(?:19|20)[0-9][0-9]")
_MONTH = {f"{m:0{w}d}" for m in range(1, 13) for w in (1, 2)}
_DAY = {f"{d:0{w}d}" for d in range(1, 32) for w in (1, 2)}
#: Signs that may stand between the parts of a date, twice the same or not at all.
_BETWEEN = "-/._"
#: Guesses for a segment's kind and place, in powers of ten; it keeps many small segments from being free.
PER_SEGMENT = 1.0


def _alphabet(value: str) -> float:
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 10 * any("0" <= c <= "9" for c in value) + 33 * any(c.isascii() and not c.isalnum() for c in value)
    return math.log10(max(size + 100 * (not value.isascii()), 10))


def _word_costs(value: str, i: int):
    """(length, log10 guesses) of the words that start at i; capitals and look-alike signs cost a factor each."""
    for n in range(3, min(_LONGEST, len(value) - i) + 1):
        own = value[i : i + n]
        low = own.lower()
        rank = _RANK.get(low) or _RANK.get(low.translate(_LEET))
        if rank:
            cost = math.log10(rank + 1)
            if own != low:
                cost += math.log10(2) if own[0].isupper() and own[1:].islower() else math.log10(2 + sum(c.isupper() for c in own) * 2)
            if low not in _RANK:
                cost += math.log10(2 + sum(a != b for a, b in zip(low, low.translate(_LEET), strict=True)))
            yield n, cost


def _date_lengths(value: str, i: int) -> set[int]:
    """Lengths of all dates that start at i: years, year-month-day and day-month-year, with one or two digits for month and day."""
    out = set()

    def ends(at: int, known: set[str]):
        return (at + k for k in (1, 2) if at + k <= len(value) and value[at : at + k] in known)

    def signs(at: int):
        return ("", value[at]) if at < len(value) and value[at] in _BETWEEN else ("",)

    if _YEAR.match(value, i):
        out.add(4)
        for sign in signs(i + 4):
            for month in ends(i + 4 + len(sign), _MONTH):
                if value.startswith(sign, month):
                    out |= {day - i for day in ends(month + len(sign), _DAY)}
    for day in ends(i, _DAY):
        for sign in signs(day):
            for month in ends(day + len(sign), _MONTH):
                if value.startswith(sign, month) and _YEAR.match(value, month + len(sign)):
                    out.add(month + len(sign) + 4 - i)
    return out


class _Least:
    """The least of cost[i] + f(j - i) over the places i given so far, for concave f and growing j.

    Of two places the earlier one gains on the later as j grows, so a later one that is not better at
    once never is; the others are kept, each with the j from which the one before it is no worse.
    """

    def __init__(self, f):
        self.f, self.kept = f, []

    def clear(self) -> None:
        self.kept.clear()

    def add(self, i: int, cost: float, j: int, last: int) -> None:
        if self.least(j) <= cost + self.f(j - i):
            return
        until = math.inf
        while self.kept:
            b, below, own = self.kept[-1]
            lo, hi = j, last + 1  # the first j from which the one below is no worse, last + 1 if none
            while lo < hi:
                mid = (lo + hi) // 2
                if below + self.f(mid - b) <= cost + self.f(mid - i):
                    hi = mid
                else:
                    lo = mid + 1
            until = lo
            if own > until:
                break
            self.kept.pop()
            until = math.inf
        self.kept.append((i, cost, until))

    def least(self, j: int) -> float:
        while self.kept and self.kept[-1][2] <= j:
            self.kept.pop()
        return self.kept[-1][1] + self.f(j - self.kept[-1][0]) if self.kept else math.inf


def log10_guesses(value: str) -> float:
    """The least number of guesses, as a power of ten, over all segmentations of a value.

    best[j] is the least cost of the first j characters; a segment i..j is a common word, a date, a
    repeat (3 or more of one character, or 2 or more of a unit of 2 to 4), a keyboard walk of 3 or more
    keys, or brute force at the alphabet of the whole value. Every length of each is tried: brute force
    extends by one character, and repeats and walks, whose costs are concave in their lengths, by
    :class:`_Least`, so the time is in proportion to the length (times its logarithm).
    """
    n = len(value)
    if not n:
        return 0.0
    low = "".join(c if len(c) == 1 else own for own, c in zip(value, map(str.lower, value), strict=True))  # as long as the value
    per_char = _alphabet(value)
    walk_base, walk_step = math.log10(47 * 4), math.log10(1.6)
    walks = _Least(lambda k: walk_base + math.log10(k) + (k - 1) * walk_step)
    repeats = {size: [_Least(lambda k, unit=size * per_char: unit + math.log10(k)) for _ in range(size)] for size in (1, 2, 3, 4)}
    adjacent, echo = 0, dict.fromkeys(repeats, 0)  # how long the walk, and the repeat of each size, has gone on
    best, force = [0.0] + [math.inf] * n, math.inf
    for j in range(n + 1):
        if j:
            force = min(force, best[j - 1] + PER_SEGMENT) + per_char
            cost = min(best[j], force)
            adjacent = adjacent + 1 if j > 1 and low[j - 1] in NEAR.get(low[j - 2], ()) else 0
            if adjacent >= 2:
                walks.add(j - 3, best[j - 3], j, n)
                cost = min(cost, walks.least(j) + PER_SEGMENT)
            else:
                walks.clear()
            for size, own in repeats.items():
                echo[size] = echo[size] + 1 if j > size and low[j - 1] == low[j - 1 - size] else 0
                times = 3 if size == 1 else 2
                if not echo[size]:
                    for x in own:
                        x.clear()
                elif echo[size] >= (times - 1) * size:
                    x, at = own[j % size], j // size
                    x.add(at - times, best[j - times * size], at, n // size + 1)
                    cost = min(cost, x.least(at) + PER_SEGMENT)
            best[j] = cost
        here = best[j] + PER_SEGMENT
        for k, c in _word_costs(value, j):
            best[j + k] = min(best[j + k], here + c)
        for k in _date_lengths(value, j) if value[j : j + 1].isdecimal() else ():
            best[j + k] = min(best[j + k], here + math.log10(365 * 130 if k > 4 else 130))
    return best[n]


def base_spans(text: str, hinted: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start, then kind."""
    out = []
    if hinted:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, least: float = MIN_LOG10_GUESSES) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, log10 guesses) of the values in credential contexts that are hard to guess.

    Names are read once each, whatever their length. A value that is easy to guess may hold names
    with values of their own (``tokens: pwd: ...``); one that is a span holds no other.
    """
    out, done = [], 0
    for name in NAME.finditer(text):
        sign = SIGN.match(text, name.end())
        value = VALUE.match(text, sign.end()) if sign and sign.end() >= done else None
        if value:
            a, b = value.span(value.lastindex)
            if b - a >= MIN_VALUE and (cost := log10_guesses(text[a:b])) >= least:
                out.append((a, 3, b, cost))
                done = b
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None, least: float = MIN_LOG10_GUESSES) -> dict:
    text = text or ""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    base = base_spans(text, hinted)
    more = guess_spans(text, least) if hinted else []
    return {"base": base, "guess": more, "all": sorted([*base, *((a, k, b) for a, k, b, _ in more)])}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_LOG10_GUESSES) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans``, ``max_log10_guesses``.

    Base spans are whole pattern matches, leftmost and non-overlapping per kind. The method adds a
    span of kind ``guess`` for each value in a credential context (a wider set of names, with anything
    before and after the keyword, quoting and characters than the base's) whose cheapest segmentation takes ``10**least`` guesses or more;
    placeholders such as ``password = changeme123`` stay below. Offsets are code points in the whole
    text, ends exclusive. Null and empty texts have no spans (null ``max_log10_guesses``); a row is
    scanned on its own, with no shuffle, whatever its length, and repeated rows give repeated rows. An
    empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_log10_guesses double"

    def run(batches):
        for batch in batches:
            out = [scan_text(t.as_py(), least) for t in batch.column(1)]
            counts = [[sum(k == kind for _, k, _ in x["base"]) for x in out] for kind in range(3)]
            columns = [
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([len(x["guess"]) for x in out], pa.int64()),
                pa.array([hashlib.sha256(joined(x["base"]).encode()).hexdigest() for x in out], pa.string()),
                pa.array([joined(x["all"]) for x in out], pa.string()),
                pa.array([max((round(g[3], 6) for g in x["guess"]), default=None) for x in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
