"""Labelled examples for the first trees of the PII operator, written by rule from a seed.

Each text has invented words around one value, which is personal or only looks like it. Personal: keys and passwords behind
naming words, keys of the public forms that services hand out, numbers of persons, phones and accounts, addresses with
spelled-out signs. Look-alikes: hashes, ids, paths, placeholders behind naming words, years, dates, pages, book numbers,
versions, card numbers whose check digit is wrong, meetings "at" a place; and numbers behind a plus, since these are the base
kind's to judge, which doesn't retry the ones that fail. Nothing is read from any table.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterator

HEX, DIGITS, LOWER, UPPER = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIXED = LOWER + UPPER + DIGITS
#: Words that name a secret, words that name a number, and what stands for a value that isn't given.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "access_key", "Password", "TOKEN")
NUMBER_NAMES = ("ssn", "social security number", "phone", "telephone", "tel.", "mobile", "cell", "call", "call me at", "fax", "passport", "account", "account no.")
PLACEHOLDERS = ("None", "null", "nil", "true", "false", "xxxx", "xxxxxxxx", "****", "********", "...", "${TOKEN}", "$PASSWORD", "{{secret}}", "%s", "{}", "os.environ", "getpass()", "self.token", "0", "1", "undefined", "[hidden]")
#: Beginnings of keys as services publish them, with the signs and lengths of the rest.
KEY_FORMS = (("AKIA", UPPER + DIGITS, 16), ("ASIA", UPPER + DIGITS, 16), ("ghp_", MIXED, 36), ("sk_live_", MIXED, 24), ("glpat-", MIXED, 20), ("AIza", MIXED + "_-", 35))

#: A piece of a text, and the part of it that is personal (None: nothing).
Piece = tuple[str, str | None]


def some(rnd: random.Random, signs: str, n: int) -> str:
    return "".join(rnd.choice(signs) for _ in range(n))


def key(rnd: random.Random, signs: str, n: int) -> str:
    """With a letter and a digit at least."""
    while True:
        value = some(rnd, signs, n)
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return value


def words(rnd: random.Random, n: int) -> str:
    out = [some(rnd, LOWER + rnd.choice(("é", "ñ", "ß", "a")), rnd.randint(1, 9)) for _ in range(n)]
    return " ".join(w.capitalize() + rnd.choice(("", ".", ",", "!!")) if rnd.random() < 0.2 else w for w in out)


def phone_form(rnd: random.Random) -> str:
    d = lambda n: some(rnd, DIGITS, n)
    return rnd.choice((f"({d(3)}) {d(3)}-{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(7)}"))


def secret(rnd: random.Random) -> Piece:
    d = rnd.random()
    sign, quote = rnd.choice(("=", " = ", ": ", ":", "=", " == ")), rnd.choice(("", '"', "'"))
    named = lambda v: f"{rnd.choice(SECRET_NAMES)}{sign}{quote}{v}{quote}"
    if d < 0.3:
        value = key(rnd, rnd.choice((HEX, MIXED, MIXED + "+/_-")), rnd.choice((16, 18, 20, 24, 32, 40, 64, 128, 300)))
        return named(value), value
    if d < 0.42:
        value = rnd.choice((some(rnd, LOWER, rnd.randint(5, 9)), some(rnd, LOWER, rnd.randint(4, 8)) + some(rnd, DIGITS, rnd.randint(1, 4)), key(rnd, MIXED + "!#*", rnd.randint(6, 14))))
        return rnd.choice(SECRET_NAMES) + rnd.choice(("=", ":", "='", '="', ": ")) + value, value
    if d < 0.46:
        value = words(rnd, 2).replace(",", "").lower()
        return f"{rnd.choice(SECRET_NAMES)} = '{value}'", value
    if d < 0.6:
        lead, signs, n = rnd.choice(KEY_FORMS)
        value = lead + key(rnd, signs, n)
        return rnd.choice(("", "", "key ", "login with ")) + value, value
    if d < 0.68:
        value = key(rnd, MIXED + "+/", rnd.choice((32, 40, 44)))
        return rnd.choice(("Authorization: Bearer ", "credentials ", "private key ", "user login ")) + value, value
    if d < 0.78:
        return named(rnd.choice(PLACEHOLDERS)), None
    return rnd.choice((
        rnd.choice(("", "commit ", "sha1 ", "md5 ", "hash ", "version ", "url ", "build ")) + key(rnd, HEX, rnd.choice((16, 20, 24, 32, 40, 40, 64))),
        rnd.choice(("", "id ", "uuid ")) + str(uuid.UUID(int=rnd.getrandbits(128))),
        some(rnd, DIGITS, rnd.randint(16, 20)),
        "-".join(some(rnd, LOWER, rnd.randint(3, 7)) for _ in range(4)) + f"-{rnd.randint(1, 99)}",
        "/".join(some(rnd, LOWER, rnd.randint(3, 7)) for _ in range(4)) + f"{rnd.randint(1, 99)}",
        "_".join(some(rnd, UPPER, rnd.randint(3, 9)) for _ in range(3)) + f"_{rnd.randint(1, 99)}",
        "".join(some(rnd, LOWER, rnd.randint(3, 7)).capitalize() for _ in range(4)) + f"{rnd.randint(1, 99)}",
        rnd.choice(LOWER) * rnd.randint(16, 40) + "1",
    )), None


def number(rnd: random.Random) -> Piece:
    d = rnd.random()
    digits = lambda n: some(rnd, DIGITS, n)
    year = lambda: f"{rnd.randint(1700, 2099)}"
    if d < 0.3:
        value = rnd.choice((f"{digits(3)}-{digits(2)}-{digits(4)}", phone_form(rnd), f"{digits(4)} {digits(4)} {digits(3)}"))
        return rnd.choice(NUMBER_NAMES) + rnd.choice((" ", ": ", " ", " #")) + value, value
    if d < 0.5:
        area = f"({digits(3)}) {digits(3)}-{digits(4)}"
        behind = rnd.choice(("", "", " " + digits(rnd.randint(5, 16)), f" {digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}"))
        return (f"+1 {area} {digits(rnd.randint(5, 16))}", None) if rnd.random() < 0.4 else (area + behind, area)
    if d < 0.58:
        value = f"{digits(3)}-{digits(3)}-{digits(4)}"
        return rnd.choice(("contact ", "customer ", "user name ", "private ")) + value, value
    return rnd.choice((
        f"{year()}-{year()}", f"{rnd.choice(('call', 'account', 'cell', 'the years', 'pages', 'of'))} {year()}-{year()}",
        f"{year()}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.{year()}",
        f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/{year()} {rnd.randint(10, 23)}", f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        f"pages {digits(2)}-{digits(2)} of {year()}-{year()}", "-".join(digits(4) for _ in range(4)), " ".join(digits(rnd.randint(1, 3)) for _ in range(9)),
        f"version {digits(1)}.{digits(2)}.{digits(4)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"{digits(7)} {digits(8)}", f"{digits(2)}.{digits(5)} {digits(2)}.{digits(5)}",
    )), None


def contact(rnd: random.Random) -> Piece:
    low = lambda a, b: some(rnd, LOWER, rnd.randint(a, b))
    name = rnd.choice((low(2, 8), f"{low(1, 6)}.{low(2, 8)}", low(3, 8) + some(rnd, DIGITS, rnd.randint(1, 3)), "x" * rnd.randint(2, 300)))
    host, end = low(3, 9) + rnd.choice(("", some(rnd, DIGITS, 1))), rnd.choice(("com", "org", "net", "de", "fr", "es", "edu", "co"))
    a, b = rnd.choice((("(", ")"), ("[", "]"), ("{", "}")))
    lead = rnd.choice(("", "", "write ", "mail ", "contact ", "reach "))
    d = rnd.random()
    if d < 0.35:
        value = rnd.choice((f"{name} {a}at{b} {host} {a}dot{b} {end}", f"{name}{a}at{b}{host}{a}dot{b}{end}", f"{name} {a}at{b} {host}.{end}", f"{name}{{at}}{low(1, 3)}.{low(1, 3)}.{low(1, 3)}"))
        return lead + value, value
    if d < 0.55:
        value = f"{name} at {host} dot {end}"
        return rnd.choice(("write ", "mail ", "contact ", "reach ", "user ")) + value, value
    return rnd.choice((f"we met at {low(4, 9)}{rnd.randint(0, 99)} dot {some(rnd, HEX, 4)}", f"look at {low(4, 9)} dot {rnd.randint(10, 9999)}", f"start at {low(3, 8)} dot {rnd.randint(1, 99)}", f"stay at the.{low(3, 8)} dot {rnd.randint(100, 999)}")), None


MAKERS: dict[str, Callable[[random.Random], Piece]] = {"secret": secret, "number": number, "contact": contact}


def examples(kind: str, n: int, seed: int) -> Iterator[tuple[str, tuple[int, int] | None]]:
    """n texts for a kind, each with the place of its personal value, if it has one."""
    rnd = random.Random(f"{kind} {seed}")
    for _ in range(n):
        piece, value = MAKERS[kind](rnd)
        before = words(rnd, rnd.randint(0, 8))
        before += rnd.choice((" ", " ", "\n", ". ")) if before else ""
        text = before + piece + rnd.choice((" ", " ", "\n", ". ", ", ", "### ")) + words(rnd, rnd.randint(0, 8))
        start = len(before) + piece.rindex(value) if value else 0
        yield text, (start, start + len(value)) if value else None
