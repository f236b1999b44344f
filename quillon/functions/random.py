"""Seeded random values as Columns: a value is a hash of the row's key, the place of the draw and the seed, so it is the same for any partitioning.

A Draw is made for a key (a long that is different for each row) and hands out values in turn. Dictionaries are small ones of our own.
Names follow the placeholders of JSON templates: call("integer", 1, 9) and draw.integer(1, 9) are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import CODE_DIGITS, id_card_check

FIRST = ("Ada", "Bela", "Cora", "Dino", "Ella", "Finn", "Gus", "Hana", "Ivo", "Jule", "Kai", "Lia", "Milo", "Nora", "Otto", "Pia")
LAST = ("Arden", "Bloom", "Castell", "Dorn", "Ekberg", "Falk", "Grove", "Holm", "Ives", "Jarvis", "Kern", "Lund", "Marsh", "North", "Oakes", "Pell")
WORDS = ("amber", "brook", "cedar", "delta", "ember", "frost", "grain", "harbor", "inlet", "juniper", "kettle", "linen", "meadow", "nectar", "orchid", "pebble")
CHINESE_FIRST = ("伟", "芳", "娜", "敏", "静", "丽", "强", "磊", "军", "洋", "勇", "艳", "杰", "娟", "涛", "明")
CHINESE_LAST = ("王", "李", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "徐", "孙", "胡", "朱", "高", "林")
CHINESE_WORDS = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经"
REGIONS = ("North", "South", "East", "West", "Middle")
PROVINCES = ("Aldland", "Brinshire", "Calderon", "Dunmark", "Elsland", "Farrowby")
CITIES = ("Aldburg", "Brinmouth", "Caldera", "Dunmere", "Elstow", "Farrow", "Glenhold", "Harwick")
COUNTIES = ("Upper Vale", "Lower Vale", "Hillside", "Riverbank", "Old Town", "New Town")
ROADS = ("Mill Road", "Church Lane", "Station Street", "Park Avenue", "Bridge Street", "Market Square")
DOMAINS, TLDS, PROTOCOLS = ("example.com", "example.org", "example.net"), ("com", "org", "net", "io", "dev"), ("http", "https", "ftp", "ws")
COMPANIES, KINDS = ("Amber", "Brook", "Cedar", "Delta", "Ember", "Frost"), ("Works", "Foods", "Systems", "Trading", "Labs")
DEPARTMENTS, POSITIONS = ("Sales", "Finance", "Support", "Research", "Legal", "Logistics"), ("Clerk", "Analyst", "Engineer", "Manager", "Director")
CURRENCIES, GENDERS = ("EUR", "USD", "GBP", "JPY", "CNY", "CHF"), ("male", "female")
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64) Demo/1.0", "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Demo/2.1", "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Demo/3.2")
MIMES, ENDINGS = ("text/plain", "text/html", "application/json", "image/png", "application/pdf"), ("txt", "csv", "json", "png", "pdf", "zip")
AREAS = ("110101", "310104", "440106", "330102", "510104")
PHONES = ("130", "131", "135", "150", "158", "180", "186", "189")
SIZES = ("300x250", "250x250", "240x400", "336x280", "180x150", "720x300")
POOLS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "number": "0123456789", "symbol": "!@#$%^&*()[]"}
POOLS["alpha"] = POOLS["lower"] + POOLS["upper"]
DAY = 86400


def luhn(digits: Column) -> Column:
    """The digits with their check digit behind."""
    n = F.length(digits)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + d)
    return F.when(n > 0, F.concat(digits, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")))


class Draw:
    def __init__(self, key: Column, seed: int = 1, path: str = "", counters: dict[str, int] | None = None, row: Column | None = None):
        self.key, self.seed, self.path, self.count = key, seed, path, 0
        self.row = row if row is not None else key  # what increments count
        self.counters = counters if counters is not None else {}

    def below(self, name: str, key: Column | None = None) -> Draw:
        """Draws of a part, which don't depend on how many its neighbours take."""
        return Draw(key if key is not None else self.key, self.seed, f"{self.path}/{name}", self.counters, self.row)

    # --- numbers

    def n(self, n: int | Column) -> Column:
        """From 0 to n - 1."""
        self.count += 1
        return F.pmod(F.xxhash64(self.key, F.lit(f"{self.path}#{self.count}"), F.lit(self.seed)), n if isinstance(n, Column) else F.lit(int(n)))

    def integer(self, lo: int = -1000, hi: int = 1000) -> Column:
        lo, hi = (int(lo), int(hi)) if int(lo) <= int(hi) else (int(hi), int(lo))
        return self.n(hi - lo + 1) + F.lit(lo).cast("long")

    def natural(self, lo: int = 0, hi: int = 1000) -> Column:
        return self.integer(max(int(lo), 0), max(int(hi), 0))

    def float(self, lo: float = 0, hi: float = 1000, least: int = 2, most: int | None = None) -> Column:
        """Between two numbers, with `least` to `most` places."""
        most = int(most if most is not None else least)
        scale = 10 ** most
        x = self.n(max(int((float(hi) - float(lo)) * scale), 0) + 1).cast("double") / scale + float(lo)
        if most == int(least):
            return F.round(x, most)
        places = self.integer(least, most)
        return F.coalesce(*[F.when(places == p, F.round(x, p)) for p in range(int(least), most + 1)])

    def bool(self, yes: int = 1, no: int = 1, value: Any = True) -> Column:
        """value with the chance of `yes` in yes + no; else its opposite."""
        hit = self.n(max(int(yes) + int(no), 1)) < int(yes)
        return hit if value else ~hit

    def double(self, lo: float, hi: float, places: int = 2) -> Column:
        return self.float(lo, hi, places)

    def range(self, start: int, stop: int | None = None, step: int = 1) -> Column:
        start, stop = (0, start) if stop is None else (start, stop)
        values = list(range(int(start), int(stop), int(step)))
        return F.array(*[F.lit(v) for v in values]) if len(values) <= 200 else F.sequence(F.lit(int(start)), F.lit(values[-1]), F.lit(int(step)))

    def increment(self, step: int = 1) -> Column:
        """Numbers that go up by `step` from row to row, in the order of the rows' numbers."""
        return (self.row + 1) * int(step)

    # --- characters

    def character(self, pool: str = "alpha") -> Column:
        chars = POOLS.get(pool, pool) or POOLS["alpha"]
        return F.substring(F.lit(chars), (self.n(len(chars)) + 1).cast("int"), F.lit(1))

    def _many(self, n: Column, one: Callable[[Draw], Column], separator: str = "") -> Column:
        self.count += 1
        path = f"{self.path}#{self.count}"
        each = F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda i: one(Draw(F.xxhash64(self.key, i), self.seed, path, self.counters, self.row)))
        return F.when(n <= 0, "").otherwise(F.array_join(each, separator))

    def string(self, *args: Any) -> Column:
        """string(length), string(pool, length), string(low, high), string(pool, low, high)."""
        pool, sizes = POOLS["alpha"], list(args)
        if sizes and isinstance(sizes[0], str) and not sizes[0].lstrip("-").isdigit():
            pool = POOLS.get(sizes.pop(0), args[0]) or POOLS["alpha"]
        n = self.integer(*map(int, sizes[:2])) if len(sizes) >= 2 else F.lit(int(sizes[0])) if sizes else self.integer(3, 7)
        return self._many(n, lambda d: d.character(pool))

    def alphabetic(self, n: int) -> Column:
        return self.string("alpha", n)

    def alphanumeric(self, n: int) -> Column:
        return self.string(CODE_DIGITS, n)

    def numeric(self, n: int) -> Column:
        return self.string("number", n)

    def ascii(self, n: int) -> Column:
        """Printable characters from space to tilde."""
        return self.string("".join(map(chr, range(32, 127))), n)

    def code(self, n: int = 6) -> Column:
        return self.alphanumeric(n)

    def password(self, lo: int = 8, hi: int = 16) -> Column:
        return self.string(CODE_DIGITS + "!@#$%", int(lo), int(hi))

    def token(self, n: int = 32) -> Column:
        return self.string("0123456789abcdef", n)

    # --- choice

    def pick(self, *of: Any) -> Column:
        of = list(of[0]) if len(of) == 1 and isinstance(of[0], list | tuple) else list(of)
        return F.element_at(F.array(*map(F.lit, of)), (self.n(len(of)) + 1).cast("int"))

    one_of = pick

    def shuffle(self, *of: Any) -> Column:
        of = list(of[0]) if len(of) == 1 and isinstance(of[0], list | tuple) else list(of)
        self.count += 1
        tagged = F.array(*[F.struct(F.xxhash64(self.key, F.lit(f"{self.path}#{self.count}.{i}"), F.lit(self.seed)).alias("h"), F.lit(v).alias("v")) for i, v in enumerate(of)])
        return F.transform(F.array_sort(tagged), lambda x: x["v"])

    # --- time

    def _time(self, start: str = "1970-01-01", days: int = 20000) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(F.lit(f"{start} 00:00:00").cast("timestamp")) + self.n(days * DAY))

    def date(self, pattern: str = "yyyy-MM-dd") -> Column:
        return F.date_format(self._time(), pattern)

    def time(self, pattern: str = "HH:mm:ss") -> Column:
        return F.date_format(self._time(), pattern)

    def datetime(self, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
        return F.date_format(self._time(), pattern)

    def timestamp(self, unit: str = "ms") -> Column:
        t = F.unix_timestamp(self._time())
        return t * 1000 if unit == "ms" else t

    def now(self, unit: str = "", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
        """The time of the query, cut to a unit."""
        if unit and unit not in ("year", "month", "week", "day", "hour", "minute", "second"):
            unit, pattern = "", unit
        t = F.current_timestamp()
        return F.date_format(F.date_trunc(unit, t) if unit else t, pattern)

    def birthday(self, youngest: int = 18, oldest: int = 65) -> Column:
        return F.date_sub(F.date_sub(F.lit("2025-01-01").cast("date"), int(youngest) * 365), self.n((int(oldest) - int(youngest)) * 365 + 1).cast("int"))

    # --- colours, images

    def hex(self) -> Column:
        return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(self.n(1 << 24)), 6, "0")))

    def color(self, *_: Any) -> Column:
        return self.hex()

    def rgb(self) -> Column:
        return F.format_string("rgb(%d, %d, %d)", self.n(256), self.n(256), self.n(256))

    def rgba(self) -> Column:
        return F.format_string("rgba(%d, %d, %d, %.2f)", self.n(256), self.n(256), self.n(256), self.float(0, 1, 2))

    def hsl(self) -> Column:
        return F.format_string("hsl(%d, %d, %d)", self.n(361), self.n(101), self.n(101))

    def image(self, size: str = "", background: str = "", foreground: str = "", kind: str = "png", text: str = "") -> Column:
        s = F.lit(size) if size else self.pick(SIZES)
        tail = "".join(f"/{x.lstrip('#')}" for x in (background, foreground) if x)
        return F.concat(F.lit("https://img.example.com/"), s, F.lit(f"{tail}.{kind.lstrip('.')}" + (f"&text={text}" if text else "")))

    def dataImage(self, size: str = "", text: str = "") -> Column:
        """A picture as a data URI: a rectangle of a colour with its size or a text."""
        s = F.lit(size) if size else self.pick(SIZES)
        w, h = F.substring_index(s, "x", 1), F.substring_index(s, "x", -1)
        svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('"><rect width="100%" height="100%" fill="'), self.hex(), F.lit('"/><text x="10" y="20">'), F.lit(text) if text else s, F.lit("</text></svg>"))
        return F.concat(F.lit("data:image/svg+xml;base64,"), F.translate(F.base64(svg.cast("binary")), "\r\n", ""))

    # --- text

    def _size(self, args: tuple, lo: int, hi: int) -> Column:
        return self.integer(*map(int, args[:2])) if len(args) >= 2 else F.lit(int(args[0])) if args else self.integer(lo, hi)

    def word(self, *size: int) -> Column:
        return self._many(self._size(size, 3, 10), lambda d: d.character("lower"))

    def sentence(self, *size: int) -> Column:
        text = self._many(self._size(size, 12, 18), lambda d: d.pick(WORDS), " ")
        return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30), F.lit("."))

    def paragraph(self, *size: int) -> Column:
        return self._many(self._size(size, 3, 7), lambda d: d.sentence(5, 12), " ")

    def title(self, *size: int) -> Column:
        return F.initcap(self._many(self._size(size, 3, 7), lambda d: d.pick(WORDS), " "))

    def cword(self, *args: Any) -> Column:
        pool, sizes = CHINESE_WORDS, list(args)
        if sizes and isinstance(sizes[0], str) and not sizes[0].isdigit():
            pool = sizes.pop(0)
        return self._many(self._size(tuple(sizes), 1, 1), lambda d: d.character(pool))

    def csentence(self, *size: int) -> Column:
        return F.concat(self.cword(*(size or (12, 18))), F.lit("。"))

    def cparagraph(self, *size: int) -> Column:
        return self._many(self._size(size, 3, 7), lambda d: d.csentence(8, 14))

    def ctitle(self, *size: int) -> Column:
        return self.cword(*(size or (3, 7)))

    def capitalize(self, text: str = "") -> Column:
        return F.lit(text[:1].upper() + text[1:])

    def upper(self, text: str = "") -> Column:
        return F.lit(text.upper())

    def lower(self, text: str = "") -> Column:
        return F.lit(text.lower())

    # --- people

    def first(self) -> Column:
        return self.pick(FIRST)

    def last(self) -> Column:
        return self.pick(LAST)

    def name(self, middle: bool = False) -> Column:
        return F.concat_ws(" ", self.first(), self.first() if middle is True or middle == "true" else F.lit(None), self.last())

    def cfirst(self) -> Column:
        return self.pick(CHINESE_FIRST)

    def clast(self) -> Column:
        return self.pick(CHINESE_LAST)

    def cname(self) -> Column:
        return F.concat(self.clast(), self.cfirst())

    def gender(self) -> Column:
        return self.pick(GENDERS)

    def age(self, lo: int = 18, hi: int = 65) -> Column:
        return self.integer(lo, hi)

    def phone(self) -> Column:
        return F.concat(self.pick(PHONES), F.lpad(self.n(10**8).cast("string"), 8, "0"))

    def idCard(self, youngest: int = 18, oldest: int = 65) -> Column:
        body = F.concat(self.pick(AREAS), F.date_format(self.birthday(youngest, oldest), "yyyyMMdd"), F.lpad(self.n(1000).cast("string"), 3, "0"))
        return F.concat(body, id_card_check(body))

    def id(self) -> Column:
        return self.idCard()

    def person(self) -> Column:
        """One person, whose parts fit together: the birthday and the gender are those of the identity number."""
        card = self.idCard()
        male = F.substring(card, 17, 1).cast("int") % 2 == 1
        return F.struct(self.name().alias("name"), card.alias("id"), F.to_date(F.substring(card, 7, 8), "yyyyMMdd").alias("birthday"), F.when(male, "male").otherwise("female").alias("gender"), self.phone().alias("phone"))

    # --- work, money

    def company(self) -> Column:
        return F.concat_ws(" ", self.pick(COMPANIES), self.pick(KINDS))

    def department(self) -> Column:
        return self.pick(DEPARTMENTS)

    def position(self) -> Column:
        return self.pick(POSITIONS)

    def salary(self, lo: int = 3000, hi: int = 50000) -> Column:
        return self.integer(int(lo) // 100, int(hi) // 100) * 100

    def price(self, lo: float = 1, hi: float = 1000) -> Column:
        return self.float(lo, hi, 2)

    def bankCard(self) -> Column:
        return luhn(F.concat(F.lit("62"), F.lpad(self.n(10**8).cast("string"), 8, "0"), F.lpad(self.n(10**8).cast("string"), 8, "0")))

    def creditCard(self) -> Column:
        return luhn(F.concat(self.pick(("4", "51", "52", "53")), F.lpad(self.n(10**7).cast("string"), 7, "0"), F.lpad(self.n(10**6).cast("string"), 6, "0")))

    def currency(self) -> Column:
        return self.pick(CURRENCIES)

    # --- places

    def region(self) -> Column:
        return self.pick(REGIONS)

    def province(self) -> Column:
        return self.pick(PROVINCES)

    def city(self, whole: bool = False) -> Column:
        return F.concat_ws(" ", self.province(), self.pick(CITIES)) if whole is True or whole == "true" else self.pick(CITIES)

    def county(self, whole: bool = False) -> Column:
        return F.concat_ws(" ", self.city(True), self.pick(COUNTIES)) if whole is True or whole == "true" else self.pick(COUNTIES)

    def road(self) -> Column:
        return F.concat_ws(" ", self.pick(ROADS), (self.n(300) + 1).cast("string"))

    def address(self) -> Column:
        return F.concat_ws(", ", self.road(), self.city(True))

    def zip(self, n: int = 6) -> Column:
        return self.numeric(n)

    # --- the web

    def protocol(self) -> Column:
        return self.pick(PROTOCOLS)

    def tld(self) -> Column:
        return self.pick(TLDS)

    def domain(self, tld: str = "") -> Column:
        return F.concat(self.word(4, 9), F.lit("."), F.lit(tld) if tld else self.tld())

    def url(self, protocol: str = "", host: str = "") -> Column:
        return F.concat(F.lit(protocol) if protocol else self.protocol(), F.lit("://"), F.lit(host) if host else self.domain(), F.lit("/"), self.word(3, 8))

    def email(self, domain: str = "") -> Column:
        return F.concat(self.word(4, 9), F.lit("@"), F.lit(domain) if domain else self.pick(DOMAINS))

    def ip(self) -> Column:
        return F.concat_ws(".", *[(self.n(254) + 1).cast("string") for _ in range(4)])

    def mac(self) -> Column:
        return F.concat_ws(":", *[F.lpad(F.lower(F.hex(self.n(256))), 2, "0") for _ in range(6)])

    def userAgent(self) -> Column:
        return self.pick(AGENTS)

    def mime(self) -> Column:
        return self.pick(MIMES)

    def fileName(self, ending: str = "") -> Column:
        return F.concat(self.word(4, 9), F.lit("."), F.lit(ending.lstrip(".")) if ending else self.pick(ENDINGS))

    def uuid(self) -> Column:
        self.count += 1
        h = F.md5(F.concat_ws("|", self.key.cast("string"), F.lit(f"{self.path}#{self.count}"), F.lit(str(self.seed))))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))

    def guid(self) -> Column:
        return self.uuid()

    def plain_uuid(self) -> Column:
        return F.replace(self.uuid(), F.lit("-"), F.lit(""))

    # --- patterns

    def regex(self, text: str) -> Column:
        """A text that the pattern matches: literals, classes, groups, alternatives, and the quantifiers ? * + {n} {n,m} (open ones end at five more)."""
        return _Pattern(text).column(self)

    def call(self, name: str, *args: Any) -> Column:
        return call(self, name, *args)


class _Pattern:
    """A regular expression, read once on the driver."""

    def __init__(self, text: str):
        self.text, self.at = text.removeprefix("^").removesuffix("$"), 0
        self.tree = self._choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in a pattern")

    def _choice(self):
        arms = [self._chain()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            arms.append(self._chain())
        return ("choice", arms)

    def _chain(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._count(self._one()))
        return parts

    def _one(self):
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self._choice()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("a group isn't closed")
            self.at += 1
            return inner
        if c == "[":
            return ("chars", self._class())
        if c == ".":
            return ("chars", CODE_DIGITS)
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            return ("chars", {"d": "0123456789", "w": CODE_DIGITS + "_", "s": " ", "D": POOLS["alpha"], "W": "!@#$%", "S": CODE_DIGITS}.get(c, {"n": "\n", "t": "\t"}.get(c, c)))
        return ("chars", c)

    def _class(self) -> str:
        out, negated = [], self.text[self.at : self.at + 1] == "^"
        self.at += negated
        while self.at < len(self.text) and (self.text[self.at] != "]" or not out):
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                c = self.text[self.at]
                self.at += 1
                out += {"d": "0123456789", "w": CODE_DIGITS + "_", "s": " "}.get(c, c)
            elif self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                out += map(chr, range(ord(c), ord(self.text[self.at + 1]) + 1))
                self.at += 2
            else:
                out.append(c)
        self.at += 1
        return "".join(x for x in map(chr, range(33, 127)) if x not in out) if negated else "".join(dict.fromkeys(out))

    def _count(self, unit):
        import re

        m = re.compile(r"\{(\d+)(?:(,)(\d*))?\}|[?*+]").match(self.text, self.at)
        if not m:
            return (unit, 1, 1)
        self.at = m.end()
        if self.text[self.at : self.at + 1] == "?":
            self.at += 1
        if m[1]:
            lo = int(m[1])
            return (unit, lo, lo if not m[2] else int(m[3]) if m[3] else lo + 5)
        return (unit, *{"?": (0, 1), "*": (0, 5), "+": (1, 6)}[m[0]])

    def column(self, d: Draw) -> Column:
        return self._write(d, self.tree)

    def _write(self, d: Draw, unit) -> Column:
        kind, of = unit
        if kind == "chars":
            return d.character(of) if len(of) > 1 else F.lit(of)
        if len(of) == 1:
            return self._joined(d, of[0])
        which = d.n(len(of))
        return F.coalesce(*[F.when(which == i, self._joined(d, arm)) for i, arm in enumerate(of)])

    def _joined(self, d: Draw, parts) -> Column:
        out = []
        for unit, lo, hi in parts:
            if lo == hi == 1:
                out.append(self._write(d, unit))
            else:
                out.append(d._many(d.integer(lo, hi), lambda e, unit=unit: self._write(e, unit)))
        return F.concat(*out) if out else F.lit("")


GROUPS = {
    "basic": "bool boolean natural integer int float character char string str range", "date": "date time datetime timestamp now", "image": "image img dataImage", "color": "color hex rgb rgba hsl",
    "text": "paragraph sentence word title cparagraph csentence cword ctitle", "name": "first last name cfirst clast cname", "web": "url domain protocol tld email ip mac userAgent fileName mime", "address": "region province city county zip address",
    "helper": "capitalize upper lower pick shuffle", "misc": "guid uuid id increment inc regex", "person": "person phone gender age birthday idCard company department position salary price bankCard creditCard currency password token",
}
ALIASES = {"boolean": "bool", "int": "integer", "char": "character", "str": "string", "img": "image", "inc": "increment", "decimal": "float"}
EXTRA: dict[str, Callable[..., Column]] = {}


def placeholders() -> list[str]:
    return sorted({n for names in GROUPS.values() for n in names.split()} | set(EXTRA))


def placeholder_groups() -> dict[str, list[str]]:
    return {k: v.split() for k, v in GROUPS.items()} | ({"own": sorted(EXTRA)} if EXTRA else {})


def extend(name: str, make: Callable[..., Column]) -> None:
    """A placeholder of one's own: make(draw, *args)."""
    EXTRA[name] = make


def call(d: Draw, name: str, *args: Any) -> Column:
    if name in EXTRA:
        return EXTRA[name](d, *args)
    key = next((n for n in placeholders() if n.lower() == name.lower()), None)
    if key is None:
        raise ValueError(f"no placeholder @{name}")
    return getattr(d, ALIASES.get(key, key))(*args)
