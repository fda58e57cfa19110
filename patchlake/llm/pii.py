"""Format-preserving pseudonyms for personal data.

Values are found by pattern and checked (Luhn, calendar, ranges, mod 97); each is
then permuted by a keyed Feistel network over all values of its own format, so
one value has one pseudonym in every document, two values never share one, and
the holder of the key can turn them back. Check digits and dates stay valid,
separators and letter case stay where they are.

Kinds: email (local part, of 64 characters at most), phone (all digits after the
country code, which is read from the numbering plan, so separators don't matter), card
(digits after the first, Luhn kept), ip, iban (account digits, check digits made
anew), ssn, date (any day of 1900 to 2099), secret (values after password,
token, secret or key words, and access key ids).

Defined cases: null stays null with no spans; overlapping finds count for the
first kind in the list; a value that fails its check is left alone, but what ends
earlier or starts later in it is still looked for; digits of other scripts than
ASCII are no digits here; repeated values get equal pseudonyms; very long texts are
read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchlake.llm.common import map_texts

ROUNDS = 8
#: Longer emails and secrets are permuted in pieces of so many characters, so that both halves of a piece are within a round's 128 bits.
PIECE = 48
#: For examples, tests and checks only.
EXAMPLE_KEY = b"patchlake example key"
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())])
FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LETTERS, HEX, UPPER36 = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

#: Patterns of the kinds, in order of precedence.
PATTERNS = {
    "secret": r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?)(?P<secret>[A-Za-z0-9_+/\-]{8,})|\b(?P<access>(?:AKIA|ASIA)[A-Z0-9]{16})\b""",
    "email": r"(?<![A-Za-z0-9._%+\-])[._%+\-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+)@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"\b(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b",
    "ip": r"(?<![0-9.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\.?[0-9])",
    "card": r"(?<![0-9\-+])(?P<card>(?:[3-6][0-9]{3}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720))(?:[ \-]?[0-9]{4}){3}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![\-]?[0-9])",
    "phone": r"(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9\-])",
    "date": r"(?<![0-9./\-])(?P<date>[0-9]{4}(?P<d1>[-/.])[0-9]{2}(?P=d1)[0-9]{2}|[0-9]{1,2}(?P<d2>[-/.])[0-9]{1,2}(?P=d2)[0-9]{4})(?![0-9/\-]|\.[0-9])",
}
FIND = re.compile("|".join(PATTERNS.values()))
#: Kinds whose patterns can run on into what follows, with what separates their groups.
RUN_ON = {"iban": (re.compile(PATTERNS["iban"]), " "), "phone": (re.compile(PATTERNS["phone"]), " .-")}
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()
COUNTRY = re.compile(rf"\+(?:{'|'.join(CALLING_CODES)}|[0-9]{{1,3}})|")
#: Lengths of IBANs by country; others may have any.
IBAN_LENGTHS = {c: int(w[:2]) for w in (
    "15NO 16BE 18DKFOFIGLNLSDFK 19MKSI 20ATBAEEKZLTLUXKMN 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQTLSOOM 24ADCZESMDPKROSASESKTNVG 25LYPTST 26ISTR "
    "27BIDJFRGRITMCMRSM 28ALAZBYCYDOGTHUHNLBNIPLSV 29BREGPSQAUA 30JOKWMUYE 31MTSC 32LC 33RU"
).split() for c in re.findall("[A-Z]{2}", w)}
#: A text with none of these has no value of any kind.
HINT = re.compile(r"[0-9]{2}|@|A[KS]IA|[=:]\s*[\"']?[A-Za-z0-9_+/\-]{8}")


class Feistel:
    """A keyed permutation of the numbers below n, for any n: cycles are walked until the value is in range."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def part(self, label: str, k: int, x: int, size: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{label}|{k}|{x}".encode(), key=self.key[:64], digest_size=16).digest(), "big") % size

    def once(self, label: str, x: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(x, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self.part(label, k, left, b)) % b
            else:
                left = (left + sign * self.part(label, k, right, a)) % a
        return left * b + right

    def permute(self, label: str, x: int, n: int, back: bool = False) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        x = self.once(label, x, a, b, back)
        while x >= n:
            x = self.once(label, x, a, b, back)
        return x

    def digits(self, label: str, text: str, alphabet: str, back: bool = False) -> str:
        """The characters of `alphabet` in a text as one number, permuted; the others stay."""
        base = len(alphabet)
        x = n = 0
        for c in text:
            x, n = x * base + alphabet.index(c), n + 1
        x = self.permute(f"{label}:{n}", x, base**n, back)
        out = []
        for _ in range(n):
            x, r = divmod(x, base)
            out.append(alphabet[r])
        return "".join(reversed(out))


#: Days of the month over 12, with their months.
LATE = [(m, d) for m in range(1, 13) for d in range(13, 32) if d <= (29 if m == 2 else 30 if m in (4, 6, 9, 11) else 31)]


def real(x: int) -> datetime.date | None:
    """The x-th of the late days of 1900 to 2099, if that year has it."""
    year, at = divmod(x, len(LATE))
    month, day = LATE[at]
    leap = (1900 + year) % 4 == 0 and 1900 + year != 1900
    return datetime.date(1900 + year, month, day) if leap or (month, day) != (2, 29) else None


def luhn(digits: str) -> int:
    """The check digit that completes these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def put_back(shape: str, chars: str, which) -> str:
    """`chars` at the places of `shape` that satisfy `which`."""
    left = iter(chars)
    return "".join(next(left) if which(c) else c for c in shape)


def only(text: str, which) -> str:
    return "".join(c for c in text if which(c))


def mod97(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def pseudonym(f: Feistel, kind: str, value: str, back: bool = False) -> str | None:
    """The value's pseudonym (or, with `back`, the value of a pseudonym); None if the value doesn't pass its check."""
    digit = DIGITS.__contains__
    if kind == "card":
        d = only(value, digit)
        if luhn(d[:-1]) != int(d[-1]):
            return None
        if d[0] == "2":  # its first four digits stay within 2221 to 2720
            x = f.permute("card2", int(d[:-1]) - 2221 * 10**11, 500 * 10**11, back)
            body = str(2221 * 10**11 + x)
        else:
            body = d[0] + f.digits(f"card{d[0]}", d[1:-1], DIGITS, back)
        return put_back(value, body + str(luhn(body)), digit)
    if kind == "phone":
        head = COUNTRY.match(value)[0]
        rest = value[len(head) :]
        d = only(rest, digit)
        if not 7 <= len(d) + len(head) <= 16:
            return None
        return head + put_back(rest, f.digits(f"phone{head}", d, DIGITS, back), digit)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        x = f.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
        return ".".join(str(b) for b in x.to_bytes(4, "big"))
    if kind == "ssn":
        a, b, c = value.split("-")
        if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
            return None
        areas = [n for n in range(1, 900) if n != 666]
        x = (areas.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1
        x, c = divmod(f.permute("ssn", x, len(areas) * 99 * 9999, back), 9999)
        a, b = divmod(x, 99)
        return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "date":
        mark = re.search(r"[-/.]", value)[0]
        p = value.split(mark)
        year_first = len(p[0]) == 4
        day_first = not year_first and mark == "." or not year_first and int(p[0]) > 12
        y, m, d = (p[0], p[1], p[2]) if year_first else (p[2], p[1], p[0]) if day_first else (p[2], p[0], p[1])
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        if not DAYS[0] <= day <= DAYS[1]:
            return None
        if year_first or mark == "." or not day_first:
            new = datetime.date.fromordinal(DAYS[0] + f.permute(f"date{mark}{year_first}", day - DAYS[0], DAYS[1] - DAYS[0] + 1, back))
        else:  # its first number must stay over 12, or it would be read as a month
            x = f.permute("day", (int(y) - 1900) * len(LATE) + LATE.index((int(m), int(d))), 200 * len(LATE), back)
            while not real(x):
                x = f.permute("day", x, 200 * len(LATE), back)
            new = real(x)
        wide = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
        return mark.join(wide if year_first else [wide[2], wide[1], wide[0]] if day_first else [wide[1], wide[2], wide[0]])
    if kind == "iban":
        plain = value.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or 98 - mod97(country, account) != int(check):
            return None
        account = put_back(account, f.digits(f"iban{country}{re.sub(r'[0-9]', '', account)}", only(account, digit), DIGITS, back), digit)
        return put_back(value, f"{country}{98 - mod97(country, account):02d}{account}", str.isalnum)
    if kind == "access":
        return value[:4] + f.digits("access", value[4:], UPPER36, back)
    hexadecimal = kind == "secret" and re.fullmatch("[0-9a-f]+", value)
    if hexadecimal and len(value) <= 64:
        return f.digits(f"{kind}hex", value, HEX, back)
    if len(value) > PIECE:
        shape = hashlib.blake2b(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value))).encode(), digest_size=16).hexdigest()
        pieces = [(f"{kind}:{len(value)}:{'hex' if hexadecimal else shape}:{i}:", value[i : i + PIECE]) for i in range(0, len(value), PIECE)]
        return "".join(f.digits(label, p, HEX, back) if hexadecimal else runs(f, label, p, back) for label, p in pieces)
    return runs(f, f"{kind}:", value, back)


def runs(f: Feistel, label: str, value: str, back: bool) -> str:
    """The digits and letters of an email or secret permuted together; upper case and other characters stay."""
    digit = DIGITS.__contains__
    label += re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))
    letter = lambda c: c.isascii() and c.isalpha()
    d, a = only(value, digit), only(value, letter)
    x = 0
    for c in d:
        x = x * 10 + int(c)
    for c in a.lower():
        x = x * 26 + LETTERS.index(c)
    x = f.permute(label, x, 10 ** len(d) * 26 ** len(a), back)
    letters = []
    for _ in a:
        x, r = divmod(x, 26)
        letters.append(LETTERS[r])
    a = "".join(n.upper() if o.isupper() else n for n, o in zip(reversed(letters), a, strict=True))
    return put_back(put_back(value, a, letter), f"{x:0{len(d)}d}" if d else "", digit)


def sizes(kind: str, value: str) -> list[int]:
    """How many characters of a find to try: all, or where its groups end; an IBAN's country's length first, else the longest."""
    if kind not in RUN_ON:
        return [len(value)]
    pattern, marks = RUN_ON[kind]
    out = [n for n in range(len(value), 0, -1) if n == len(value) or value[n] in marks and pattern.fullmatch(value[:n])]
    if kind == "iban":
        out.sort(key=lambda n: len(value[:n].replace(" ", "")) != IBAN_LENGTHS.get(value[:2]))
    return out


def replaced(f: Feistel, text: str, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and their spans in the text given."""
    if not HINT.search(text):
        return text, []
    out, spans, end = [], [], 0
    at = 0
    while m := FIND.search(text, at):
        at = m.start() + 1  # if it fails its check
        kind = next(k for k in ("secret", "access", "email", "iban", "ip", "card", "phone", "ssn", "date") if m[k] is not None)
        if kind == "secret" and m["secret"].isalpha():  # a word
            continue
        if not re.search("[0-9A-Za-z]", m[kind]):
            continue
        tried = ((n, pseudonym(f, kind, m[kind][:n], back)) for n in sizes(kind, m[kind]))
        n, new = next((t for t in tried if t[1] is not None), (0, None))
        if new is None:
            continue
        a = m.start(kind)
        b = a + n
        at = b if n < len(m[kind]) else m.end()
        out += [text[end:a], new]
        spans.append({"kind": "secret" if kind == "access" else kind, "start": a, "end": b, "pseudonym": new})
        end = b
    return "".join([*out, text[end:]]), spans


def worker(key: bytes, back: bool):
    f = Feistel(key)

    def work(texts: list) -> list:
        done = [(None, []) if t is None else replaced(f, t, back) for t in texts]
        return [[t for t, _ in done], [len(s) for _, s in done], [s for _, s in done]]

    return work


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None, into: str = "found", back: bool = False) -> DataFrame:
    """`keep` columns and a struct: text with pseudonyms (with `back`: with the values again), n_spans, spans in the old text."""
    return map_texts(docs, partial(worker, key, back), FOUND, text, keep, into)
