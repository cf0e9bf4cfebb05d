"""Format-preserving pseudonyms of personal data by keyed Feistel permutations (operator 1)."""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns

ROUNDS = 8
#: Values of more digits and letters are permuted by halves of digits instead of as one number.
LONG = 64
#: Where a session names no key of its own; it protects nothing.
DEMO_KEY = b"a key for tests"
KEY_SETTING = "spark.demandlens.pseudonyms.key"
_DAY_ONE = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY_ONE
_GROUP = re.compile("[A-Za-z0-9]+")


class Feistel:
    """A keyed permutation of range(size) for any size, one for each tag."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _stream(self, tag: str, k: int, data: bytes, size: int) -> bytes:
        """``size`` bytes that depend on the key, the tag, the round and the data."""
        head = hashlib.blake2b(f"{len(tag)}|{tag}|{k}|".encode() + data, key=self.key, digest_size=64).digest()
        return hashlib.shake_256(head).digest(size)

    def _round(self, tag: str, k: int, value: int, modulus: int) -> int:
        wide = modulus.bit_length() // 8 + 17  # 128 bits more than the modulus, so that no value is likelier than another
        return int.from_bytes(self._stream(tag, k, value.to_bytes(value.bit_length() // 8 + 1, "big"), wide), "big") % modulus

    def permute(self, value: int, size: int, tag: str, back: bool = False, within: Callable[[int], bool] | None = None) -> int:
        """``within`` narrows the domain to the values it holds for; the walk goes on until it does."""
        left = max(1, 1 << (size.bit_length() + 1) // 2)
        right = -(-size // left)
        while True:
            a, b = divmod(value, right)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if k % 2:
                    step = self._round(tag, k, a, right)
                    b = (b - step if back else b + step) % right
                else:
                    step = self._round(tag, k, b, left)
                    a = (a - step if back else a + step) % left
            value = a * right + b
            if value < size and (within is None or within(value)):
                return value

    def permute_symbols(self, values: list[int], radixes: list[int], tag: str, back: bool = False) -> list[int]:
        """The same for a long sequence of digits of the radixes given, in time that grows with its length: each round
        adds a stream keyed by one half to the other, digit by digit."""
        half = len(values) // 2
        parts = [values[:half], values[half:]]
        bases = [radixes[:half], radixes[half:]]
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            mine, other = k % 2, 1 - k % 2
            stream = self._stream(tag, k, bytes(parts[other]), 8 * len(parts[mine]))
            steps = (int.from_bytes(stream[8 * i : 8 * i + 8], "big") for i in range(len(parts[mine])))
            parts[mine] = [(v - s if back else v + s) % r for v, s, r in zip(parts[mine], steps, bases[mine], strict=True)]
        return parts[0] + parts[1]


def luhn_digit(digits: str) -> str:
    """Check digit that makes digits + it pass the Luhn test."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _classes(text: str) -> list[tuple[int, int]]:
    """(value, radix) of each digit and ASCII letter."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append((ord(c) - 48, 10))
        elif "a" <= c <= "z":
            out.append((ord(c) - 97, 26))
        elif "A" <= c <= "Z":
            out.append((ord(c) - 65, 26))
    return out


class Pseudonyms:
    """Finds, validates and replaces values; ``back`` turns pseudonyms into the values again."""

    PATTERNS = {
        "secret": r"(?<=[\"'])[0-9a-f]{32,}(?=[\"'])",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "date": r"(?<![\d/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?![\d/-])",
        "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d)",
        "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ -]?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
        "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    }
    LOCAL = re.compile(r"[A-Za-z0-9._%+-]++@?")
    FIRST = re.compile(r"[A-Za-z0-9]")
    DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
    NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
    KINDS = {k: re.compile(p) for k, p in PATTERNS.items()}
    #: Kinds of several lengths, whose pattern can take in a neighbouring number.
    OPEN = ("iban", "phone", "card")

    def __init__(self, key: bytes, back: bool = False):
        self.feistel = Feistel(key)
        self.back = back
        self.replaced = functools.lru_cache(maxsize=1 << 16)(self._replaced)

    def _permute(self, value: int, size: int, tag: str, within=None) -> int:
        return self.feistel.permute(value, size, tag, self.back, within)

    def _mixed(self, text: str, tag: str) -> str:
        """Permute the digits and letters of a text among the texts of the same shape."""
        parts = _classes(text)
        tag = f"{tag}:{''.join('d' if r == 10 else 'a' for _, r in parts)}"
        if len(parts) > LONG:
            new = self.feistel.permute_symbols([v for v, _ in parts], [r for _, r in parts], tag, self.back)
        else:
            value, size = 0, 1
            for v, radix in parts:
                value, size = value * radix + v, size * radix
            if size == 1:
                return text
            value, new = self._permute(value, size, tag), []
            for _, radix in reversed(parts):
                value, digit = divmod(value, radix)
                new.append(digit)
            new.reverse()
        digits = iter(new)
        return "".join(chr(ord("0" if c <= "9" else "a" if c >= "a" else "A") + next(digits)) if _classes(c) else c for c in text)

    def _replaced(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, None if it isn't a valid one of its kind."""
        return getattr(self, f"_{kind}")(text)

    def _email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        return self._mixed(local, "email") + "@" + ".".join([*(self._mixed(x, "host") for x in labels[:-2]), *labels[-2:]])

    def _secret(self, text: str) -> str:
        new = self.feistel.permute_symbols([int(c, 16) for c in text], [16] * len(text), f"hex{len(text)}", self.back)
        return "".join(f"{x:x}" for x in new)

    def _iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _iban_rest(bare[4:] + bare[:4]) != 1:
            return None
        body = self._mixed(bare[4:], f"iban{bare[:2]}")
        new = iter(bare[:2] + f"{98 - _iban_rest(body + bare[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def _date(self, text: str) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        a, b, c = text.split(mark) if text.count(mark) == 2 else ("", "", "")
        orders = (("y", "m", "d"),) if len(a) == 4 else (("m", "d", "y"), ("d", "m", "y")) if mark == "/" else (("d", "m", "y"), ("m", "d", "y"))
        if not a:
            return None
        widths = (len(a), len(b), len(c))
        shape = "".join(map(str, widths)) if 1 in widths else ""

        def day(parts: tuple[str, ...], order: tuple[str, ...]) -> int | None:
            got = dict(zip(order, map(int, parts), strict=True))
            try:
                day = datetime.date(got["y"], got["m"], got["d"]).toordinal() - _DAY_ONE
            except ValueError:
                return None
            return day if 0 <= day < _DAYS else None

        def written(k: int, order: tuple[str, ...]) -> list[str]:
            d = datetime.date.fromordinal(k + _DAY_ONE)
            return [f"{d.year if x == 'y' else d.month if x == 'm' else d.day:0{n}d}" for x, n in zip(order, widths, strict=True)]

        def fits(k: int, order: tuple[str, ...]) -> bool:
            """A day or month of one digit stays one of one digit."""
            return not shape or tuple(map(len, written(k, order))) == widths

        if (k := day((a, b, c), orders[0])) is not None:
            return mark.join(written(self._permute(k, _DAYS, f"date{shape}", lambda x: fits(x, orders[0])), orders[0]))
        if len(orders) > 1 and (k := day((a, b, c), orders[1])) is not None:
            # the second reading holds only for dates that the first can't read, and stays among them
            new = self._permute(k, _DAYS, f"date2{shape}", lambda x: fits(x, orders[1]) and day(tuple(written(x, orders[1])), orders[0]) is None)
            return mark.join(written(new, orders[1]))
        return None

    def _ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
            return None
        value = self._permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        at, serial = divmod(self._permute(at, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(at, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        keep = len(re.match(r"\+(\d{1,3})(?=\D)|", text)[1] or "") if text[0] == "+" else 0
        if text[0] == "+" and not keep:
            keep = min(2, len(digits) - 7)
        rest = digits[keep:]
        if len(rest) == 10 and rest[0] >= "2" and rest[3] >= "2" and digits[:keep] in ("", "1"):
            area, exchange = int(rest[:3]) - 200, int(rest[3:6]) - 200
            at, line = divmod(self._permute((area * 800 + exchange) * 10_000 + int(rest[6:]), 6_400_000_000, "nanp"), 10_000)
            area, exchange = divmod(at, 800)
            rest = f"{area + 200}{exchange + 200}{line:04d}"
        elif len(rest) == 10 and digits[:keep] in ("", "1"):
            return None
        else:
            rest = self._mixed(rest, f"phone{digits[:keep]}")
        new = iter(digits[:keep] + rest)
        return re.sub(r"\d", lambda _: next(new), text)

    def _card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        size = len(digits) - 2
        body = digits[0] + f"{self._permute(int(digits[1:-1]), 10**size, f'card{digits[0]}', lambda x: len(set(digits[0] + str(x).zfill(size))) > 1):0{size}d}"
        new = iter(body + luhn_digit(body))
        return re.sub(r"\d", lambda _: next(new), text)

    def _within(self, part: str, begin: int, end: int) -> tuple[int, int, str, str] | None:
        """(first, end, kind, pseudonym) of the longest valid value in a match that is none itself, the leftmost of equal ones.

        Values of every kind are tried from each group of letters and digits; those of several lengths up to
        each group's end.
        """
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(part, begin, end)]
        tried = set()
        for a in {begin, *(x for x, _ in groups)}:
            for k, (kind, pattern) in enumerate(self.KINDS.items()):
                if m := pattern.match(part, a):
                    tried.add((a - m.end(), a, k, kind))
                    if kind in self.OPEN:
                        tried.update((a - b, a, k, kind) for _, b in groups if a < b < m.end() and pattern.fullmatch(part, a, b))
        for size, a, _, kind in sorted(tried):
            if (new := self.replaced(kind, part[a : a - size])) is not None:
                return a, a - size, kind, new
        return None

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        """Begin and end of each address: from the first letter or digit of a whole run of local characters before an @. Every run is read once."""
        end = 0
        for run in self.LOCAL.finditer(text):
            if text[run.end() - 1] != "@" or not (first := self.FIRST.search(text, max(run.start(), end), run.end() - 1)):
                continue
            if domain := self.DOMAIN.match(text, run.end()):
                end = domain.end()
                yield first.start(), end

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, first character, length) of each in it.

        E-mail addresses are found first, then the other kinds in what lies between them.
        """
        out: list[str] = []
        spans: list[tuple[str, int, int]] = []
        size = 0

        def put(part: str, kind: str | None = None) -> None:
            nonlocal size
            if kind:
                spans.append((kind, size, len(part)))
            out.append(part)
            size += len(part)

        def numbers(part: str) -> None:
            at = begin = 0
            while m := self.NUMBERS.search(part, begin):
                new = self.replaced(m.lastgroup, m[0])
                found = self._within(part, *m.span()) if new is None else (*m.span(), m.lastgroup, new)
                if found:
                    a, begin, kind, new = found
                    numbers(part[at:a]) if a > m.start() else put(part[at:a])
                    put(new, kind)
                    at = begin
                else:  # a value can begin in the match and end after it
                    begin = next((x.start() for x in _GROUP.finditer(part, m.start() + 1, m.end()) if not part[x.start() - 1].isalnum()), m.end())
            put(part[at:])

        at = 0
        if "@" in text:
            for begin, end in self.emails(text):
                numbers(text[at:begin])
                put(self.replaced("email", text[begin:end]), "email")
                at = end
        numbers(text[at:])
        return "".join(out), spans


_TRIGGER = re.compile("[0-9@]")


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, n_values, kinds, spans) for every row; one pass without a shuffle.

    Equal values get equal pseudonyms in every document, under every key a permutation of the values of the
    same format: cards keep their first digit and stay valid under Luhn, IBANs under mod 97, dates stay dates
    of 1900 to 2099, phone numbers keep their country code, e-mail addresses their registered domain, IPv4
    addresses stay addresses (their octets may change length), days and months of one digit stay such. Where a
    match fails validation, the longest valid value of any kind inside it is taken; what is still none stays.
    ``kinds`` counts values by kind. A null text stays null with 0 values; repeated rows are all returned. Values of
    any length are taken. Only doc_id and text are read, whatever other columns are called.
    ``back`` with the same key restores the texts but for values whose pseudonym is part of a longer match.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(key, back)
        for part in parts:
            text, count, kinds, spans = [], [], [], []
            for t in part["text"].tolist():
                found: list[tuple[str, int, int]] = []
                if t is not None and _TRIGGER.search(t):
                    t, found = names.text(t)
                by: dict[str, int] = {}
                for kind, _, _ in found:
                    by[kind] = by.get(kind, 0) + 1
                text.append(t)
                count.append(len(found))
                kinds.append(",".join(f"{k}:{by[k]}" for k in sorted(by)))
                spans.append([{"kind": k, "start": a, "length": n} for k, a, n in found])
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text": text, "n_values": count, "kinds": kinds, "spans": spans})

    schema = "doc_id long, text string, n_values long, kinds string, spans array<struct<kind: string, start: int, length: int>>"
    return doc_columns(docs, "doc_id", "text").mapInPandas(work, schema)


def linked_values(pseudonyms: DataFrame) -> DataFrame:
    """(value, kind, n_documents, n_uses): pseudonyms that link documents, counted over all of them."""
    rows = pseudonyms.select("doc_id", "text", F.explode("spans").alias("s"))
    rows = rows.select("doc_id", F.col("s.kind").alias("kind"), F.substring("text", F.col("s.start") + 1, F.col("s.length")).alias("value"))
    per = rows.groupBy("kind", "value", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("kind", "value").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_uses"))


def op1_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """The key is the caller's, or that of the session's setting KEY_SETTING."""
    key = key or (spark.conf.get(KEY_SETTING, None) or "").encode() or DEMO_KEY
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
    return found.select("doc_id", "text", "n_values", "kinds")
