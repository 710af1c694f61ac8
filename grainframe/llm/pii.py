"""Format-preserving pseudonyms for personal data.

Found values are checked before they are touched: card numbers by their Luhn digit, IBANs modulo 97, IPv4 octets by
range, dates by the calendar, telephone numbers and social security numbers by their form. A value's digits are permuted
within their format by a keyed Feistel network: the same value gets the same pseudonym in every document, different values
get different ones, and a pseudonym passes the same check. Mail addresses keep their domain and the class of each
character of the local part. Secrets assigned to a name that holds a keyword (``aws_secret_access_key = "..."``) are taken
whole, to their closing quote or to white space; they keep their length, and the class of each character. A keyword ends where
its name does, at ``_``, ``-`` or a digit, or before a capital: ``tokens`` and ``secretary`` name no secret. Nor does a plain word that
follows a colon and is followed by another. Dates are day first where that gives a day of the calendar, else month first; those
of the second kind are permuted among themselves.

One map over the documents; nothing is shuffled. Texts without a digit are passed on as they are.

Defined results: a null text stays null and an empty text stays empty, both with 0 values. Values that fail their check
stay. Names of secrets and local parts of mail addresses may be of any length. A card, IBAN or telephone number next to other digits is found by trying the ends, then the starts, that its groups
admit: lengths known for its issuer or country first, then the longest that passes. A telephone number has no check digit, so
where its country's lengths aren't known it takes as many groups as fit in 15 digits. Overlapping forms are taken left to
right, in the order of ``FORMS`` at one place. Extra columns pass through; the columns made here replace others of their
names.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainframe.llm.common import columns_of, lean, table, without

#: Where the session's key is found, and the key of tests and of queries of a session that has none.
KEY_SETTING, TEST_KEY = "spark.grainframe.pseudonymKey", "grainframe-pseudonyms"
ROUNDS = 10

FORMS = {
    "secret": r"""(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]*?(?i:api[_-]?key|access[_-]?key|secret(?:key)?|token(?:key)?|password|passwd)(?:(?<=[a-z])(?=[A-Z])|(?![A-Za-z])))(?<name>[A-Za-z0-9_\-]++)(?<link>\\?["'`]?[ \t]*+(?::=|=>|={1,2}|:)[ \t]*+(?:(?i:bearer|basic)[ ]+)?)(?:(?<open>\\?["'`])(?:(?i:bearer|basic)[ ]+)?(?<quoted>(?:(?!(?P=open))(?:\\[^\n]|[^\\\n]))++)(?P=open)|(?!(?<=:[ \t])[A-Z]?[a-z]+[.,;!?]*+[ \t]+[A-Za-z])\\?["'`]?(?<bare>[^\s"'`]++))""",
    "email": r"(?<![A-Za-z0-9._%+\-])(?=[._%+\-]*+[A-Za-z0-9])(?<local>[A-Za-z0-9._%+\-]++)@(?<domain>[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++)+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:(?<y>[0-9]{4})(?<s>[-/.])(?<m>[0-9]{2})(?P=s)(?<d>[0-9]{2})|(?<d2>[0-9]{2})(?<s2>[-/.])(?<m2>[0-9]{2})(?P=s2)(?<y2>[0-9]{4}))(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9+.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9.\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
_ANY = {kind: regex.compile(pattern) for kind, pattern in FORMS.items()}
#: Cheap signs that a form can occur at all.
_SIGNS = {"secret": regex.compile(r"(?i)key|secret|token|passw"), "email": regex.compile("@"), "iban": regex.compile(r"[A-Z]{2}[0-9]{2}")}
#: Least characters of a secret: of a password, of any other with a digit, of any other.
MIN_PASSWORD, MIN_WITH_DIGIT, MIN_SECRET = 4, 8, 16
_PASSWORD = regex.compile("(?i)passw")
#: Characters of a secret that one permutation moves; longer values are taken in blocks.
BLOCK = 64
_DIGIT, _DIGITS, _WORDS = regex.compile("[0-9]"), regex.compile("[0-9]+"), regex.compile("[A-Z0-9]+")
DATE_FROM, DATE_TO = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Days that can't be read day first when they are written month first.
_MONTH_FIRST = [day for day in range(DATE_FROM, DATE_TO + 1) if datetime.date.fromordinal(day).day > 12]


#: Digits of cards by their first digits (the longest that fits counts).
CARDS = {"4": (16, 13, 19), "34": (15,), "37": (15,), **{str(p): (16,) for p in range(51, 56)}, **{str(p): (16,) for p in range(2200, 2205)}, **{str(p): (16,) for p in range(2221, 2721)}}
CARDS |= {"6011": (16, 19), "65": (16, 19), **{str(p): (16, 19) for p in range(644, 650)}, "35": (16,), **{str(p): (14, 16, 19) for p in (36, 38, 39)}, "30": (14, 16, 19), "62": (16, 17, 18, 19)}
#: Characters of IBANs by country.
_IBANS = "NO15 BE16 DK18 FI18 FO18 GL18 NL18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 IL23 IQ23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 PT26 IS26 TR26 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 MT31 SC31 LC32"
IBANS = {x[:2]: int(x[2:]) for x in _IBANS.split()}
#: Digits of telephone numbers after the country's code; only where they vary little.
PHONES = {"1": (10,), "7": (10,), "31": (9,), "33": (9,), "34": (9,), "41": (9,), "44": (10,), "45": (8,), "47": (8,), "48": (9,), "52": (10,), "61": (9,), "91": (10,), "351": (9,), "420": (9,)}
_GROUPS = regex.compile(r"(?<![0-9+])[0-9]+(?:[ \-][0-9]+)*")
#: Fewest digits of each group of a card of a known issuer that is part of a longer run; groups of a card of any other.
LEAST_GROUP = 3
_SHAPE = regex.compile(r"1[3-9]|4(?: 4){2}(?: [1-4]){1,2}|4 6 [45]|6 (?:[7-9]|1[0-3])")


class Feistel:
    """A keyed permutation of 0 .. n - 1: an alternating Feistel network on a x b >= n, walked until it lands below n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, value: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%s|%d|%d" % (tweak, i, value), hashlib.sha256), "big")

    def permute(self, x: int, n: int, tweak: bytes = b"") -> int:
        """The place of x. Places beyond n are walked on from, so that 0 .. n - 1 is mapped onto itself."""
        return self._walk(x, n, tweak, 1)

    def restore(self, x: int, n: int, tweak: bytes = b"") -> int:
        """The value whose place is x."""
        return self._walk(x, n, tweak, -1)

    def move(self, x: int, n: int, tweak: bytes = b"") -> int:
        """The value at the place after that of x: a permutation in one cycle, so that no value keeps its own (for n > 1)."""
        return self.restore((self.permute(x, n, tweak) + 1) % n, n, tweak) if n > 1 else x

    def _walk(self, x: int, n: int, tweak: bytes, way: int) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS)[::way]:
                if i % 2 == 0:
                    left = (left + way * self._round(tweak, i, right)) % a
                else:
                    right = (right + way * self._round(tweak, i, left)) % b
            x = left * b + right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` and it pass the Luhn check."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _masked(text: str, found: list[tuple]) -> str:
    """``text`` with line ends in place of the values found."""
    out, last = [], 0
    for start, _, end, _, _ in sorted(found):
        if end > last:
            out += [text[last : max(last, start)], "\n" * (end - max(last, start))]
            last = end
    return "".join([*out, text[last:]])


class Pseudonyms:
    """Pseudonym of each kind of value; ``None`` where the value fails its check."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = lru_cache(maxsize=50_000)(self._of)

    def digits(self, digits: str, tweak: bytes) -> str:
        """A permutation of the numbers of that many digits that leaves none as it is."""
        return str(self.feistel.move(int(digits), 10 ** len(digits), tweak)).zfill(len(digits)) if digits else digits

    def letters(self, text: str, tweak: bytes) -> str:
        """Each character moves within its class (digits, small and capital letters); all others stay.

        Blocks after the first depend on all before them, so that distinct texts stay distinct and no block shows another.
        """
        out, before = [], hashlib.sha256()
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            out.append(self._block(block, tweak + before.digest() if at else tweak))
            before.update(block.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _block(self, text: str, tweak: bytes) -> str:
        kinds = [next((k for k in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in k), "") for c in text]
        n = value = 0
        size = 1
        for c, k in zip(text, kinds):
            if k:
                value, size = value * len(k) + k.index(c), size * len(k)
        new = self.feistel.move(value, size, tweak)
        out = []
        for c, k in zip(reversed(text), reversed(kinds)):
            if k:
                new, n = divmod(new, len(k))
                out.append(k[n])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _in_place(self, text: str, digits: str) -> str:
        new = iter(digits)
        return "".join(next(new) if "0" <= c <= "9" else c for c in text)

    def _of(self, kind: str, text: str) -> str | None:
        digits = "".join(c for c in text if "0" <= c <= "9")
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            body = digits[0] + self.digits(digits[1:-1], b"card%d%c" % (len(digits), ord(digits[0])))
            return self._in_place(text, body + luhn_digit(body))
        if kind == "ipv4":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            value = int.from_bytes(bytes(octets), "big")
            return ".".join(map(str, self.feistel.move(value, 1 << 32, b"ipv4").to_bytes(4, "big")))
        if kind == "phone":
            if not 7 <= len(digits) <= 15:
                return None
            keep = len(text) - len(text.lstrip("+0123456789")) - 1 if text.startswith("+") else 0
            keep = keep if 0 < keep <= 3 and not digits[keep:] == "" else 0
            return self._in_place(text, digits[:keep] + self.digits(digits[keep:], b"phone%d" % len(digits)))
        if kind == "ssn":
            area, group, serial = text.split("-")
            if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
                return None
            index = (self._areas(area) * 99 + int(group) - 1) * 9999 + int(serial) - 1
            new = self.feistel.move(index, 898 * 99 * 9999, b"ssn")
            new, serial_at = divmod(new, 9999)
            area_at, group_at = divmod(new, 99)
            area_at += 1 + (area_at + 1 >= 666)
            return f"{area_at:03d}-{group_at + 1:02d}-{serial_at + 1:04d}"
        if kind == "iban":
            flat = text.replace(" ", "")
            if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
                return None
            body = self.letters(flat[4:], b"iban" + flat[:2].encode())
            new = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
            return "".join(c if c == " " else next(new) for c in text)
        found = _ANY[kind].fullmatch(text)
        if kind == "date":
            first = found["y"] is not None
            y, m, d, mark = (int(found["y"]), int(found["m"]), int(found["d"]), found["s"]) if first else (int(found["y2"]), int(found["m2"]), int(found["d2"]), found["s2"])
            month_first = not first and m > 12
            try:
                day = (datetime.date(y, d, m) if month_first else datetime.date(y, m, d)).toordinal()
            except ValueError:
                return None
            if not DATE_FROM <= day <= DATE_TO:
                return None
            if month_first:
                days = _MONTH_FIRST
                at = datetime.date.fromordinal(days[self.feistel.move(bisect.bisect_left(days, day), len(days), b"date-month-first")])
                return f"{at.month:02d}{mark}{at.day:02d}{mark}{at.year:04d}"
            at = datetime.date.fromordinal(DATE_FROM + self.feistel.move(day - DATE_FROM, DATE_TO - DATE_FROM + 1, b"date"))
            return f"{at.year:04d}{mark}{at.month:02d}{mark}{at.day:02d}" if first else f"{at.day:02d}{mark}{at.month:02d}{mark}{at.year:04d}"
        if kind == "email":
            return self.letters(found["local"], b"email") + "@" + found["domain"]
        group = "quoted" if found["quoted"] is not None else "bare"
        value = found[group]
        least = MIN_PASSWORD if _PASSWORD.search(found["name"]) else MIN_WITH_DIGIT if _DIGIT.search(value) else MIN_SECRET
        return text[: found.start(group)] + self.letters(value, b"secret") + text[found.end(group) :] if len(value) >= least else None

    @staticmethod
    def _areas(area: str) -> int:
        return int(area) - 1 - (int(area) > 666)

    def _cards(self, text: str, known: bool) -> list[tuple[int, int, str]]:
        """Cards within runs of groups of digits: of an issuer's first digits and lengths, or of usual groups."""
        found = []
        for run in _GROUPS.finditer(text):
            if run.end() - run.start() < 13:
                continue
            groups = [(run.start() + g.start(), run.start() + g.end()) for g in _DIGITS.finditer(run[0])]
            sizes = [b - a for a, b in groups]
            i = 0
            while i < len(groups):
                ends, n, j = {}, 0, i
                while j < len(groups) and (sizes[j] >= LEAST_GROUP or not known) and (n := n + sizes[j]) <= 19:
                    j += 1
                    if n >= 13 and (known or _SHAPE.fullmatch(" ".join(map(str, sizes[i:j])))):
                        ends[n] = j
                start, head = groups[i][0], text[groups[i][0] : groups[i][1]]
                lengths = next((CARDS[head[:k]] for k in (4, 3, 2, 1) if head[:k] in CARDS), ()) if known else sorted(ends, reverse=True)
                for n in lengths:
                    if n in ends and (new := self.of("card", text[start : groups[ends[n] - 1][1]])) is not None:
                        found.append((start, groups[ends[n] - 1][1], new))
                        i = ends[n] - 1
                        break
                i += 1
        return found

    def _ends(self, kind: str, text: str, limit: int) -> list[str]:
        """The beginnings of a candidate that its groups admit and that end by ``limit``, in the order to try."""
        ends = [g.end() for g in _WORDS.finditer(text) if g.end() <= limit]
        shorter = [x for x in (text[:e] for e in reversed(ends)) if _ANY[kind].fullmatch(x)]
        if kind == "iban":
            return sorted(shorter, key=lambda x: len(x.replace(" ", "")) != IBANS.get(x[:2]))
        size = lambda x: sum("0" <= c <= "9" for c in x)
        digits = "".join(c for c in text if "0" <= c <= "9")
        lengths = [len(c) + n for c, many in PHONES.items() if text.startswith("+") and digits.startswith(c) for n in many]
        return sorted(shorter, key=lambda x: size(x) not in lengths)

    def _spans(self, kind: str, text: str, stops: list[int]) -> list[tuple[int, int, str]]:
        """Values of a form that isn't bound to one length, none across one of the ``stops``: after a failure, later starts inside the candidate are tried."""
        found, at = [], 0
        while m := _ANY[kind].search(text, at):
            k = bisect.bisect_right(stops, m.start())
            limit = (stops[k] if k < len(stops) else m.end()) - m.start()
            at = m.start() + 1
            for value in self._ends(kind, m[0], limit):
                if (new := self.of(kind, value)) is not None:
                    found.append((m.start(), at := m.start() + len(value), new))
                    break
        return found

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values replaced, and how many of each kind."""
        if not _DIGIT.search(text) and "@" not in text and not _SIGNS["secret"].search(text):
            return text, {}
        found, order = [], list(_ANY)
        add = lambda kind, spans: found.extend((a, order.index(kind), b, kind, new) for a, b, new in spans)
        cards = self._cards(text, True)
        add("card", cards)
        for at, (kind, pattern) in enumerate(_ANY.items()):
            if kind in _SIGNS and not _SIGNS[kind].search(text):
                continue
            if kind in ("iban", "phone"):
                add(kind, self._spans(kind, text, [a for a, _, _ in cards] if kind == "phone" else []))
                continue
            rest = text
            if kind == "card":
                rest = _masked(text, found)
                add(kind, self._cards(rest, False))
                rest = _masked(text, found)
            for m in pattern.finditer(rest):
                new = self.of(kind, m[0])
                if new is not None:
                    found.append((m.start(), at, m.end(), kind, new))
        out, last, counts = [], 0, {}
        for start, _, end, kind, new in sorted(found):
            if start >= last:
                out += [text[last:start], new]
                last = end
                counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[last:]]) if out else text, counts


def key_of(spark: SparkSession, otherwise: str | None = None) -> bytes:
    """The session's key. A session without one gets ``otherwise``, which only registered queries and tests give; else that is an error."""
    key = spark.conf.get(KEY_SETTING, None) or otherwise
    if not key:
        raise ValueError(f"set {KEY_SETTING}: pseudonyms need a key of their own")
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counts: str | None = "pii_counts") -> DataFrame:
    """``docs`` with values replaced in ``text``, and, with a name for it, ``counts``: a map from kind to number."""
    if not key:
        raise ValueError("pseudonyms need a key")
    made = [counts] if counts else []
    text = next((c for c in docs.columns if c.lower() == text.lower()), text)
    base = without(docs, *made).withColumn(text, F.col(f"`{text}`").cast("string"))
    names = base.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = Pseudonyms(key)
        for batch in batches:
            found = [(None, {}) if x is None else names_of.apply(x) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in found], pa.string())
            if counts:
                columns.append(pa.array([list(c.items()) for _, c in found], pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return base.mapInArrow(lean(run), columns_of(base) + (f", `{counts}` map<string,bigint>" if counts else ""))


def op6(spark, sf_dir: str) -> DataFrame:
    """``op6_pii_pseudonyms``: every document's text under pseudonyms, and the number of values of each kind."""
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark, TEST_KEY))
    return found.select("doc_id", "text", *(F.coalesce(F.col("pii_counts")[kind], F.lit(0)).cast("long").alias(f"n_{kind}") for kind in FORMS))
