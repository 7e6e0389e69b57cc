"""Labelled spans to learn from: personal data and its look-alikes, planted into texts of the corpus.

A plant is (before, form, after, kind or None). Its form stands between words of a text; the label
comes from what was planted, never from a rule on what is seen. Forms that mean something only by
what precedes them (a hex run, a number with dashes) are planted after words that tell and after
words that deny, and not where a reader could not say either.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

SECRET_WORDS = ("token", "secret", "api_key", "apikey", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "access_key", "private_key", "passphrase", "pin")
CONTACT_WORDS = ("call", "phone", "tel", "fax", "mobile", "mail", "email", "e-mail", "contact", "write to", "reach", "whatsapp", "dial", "sms")
NETWORK_WORDS = ("ip", "host", "server", "address", "addr", "gateway", "dns", "node", "ping", "ssh", "peer", "client")
CARD_WORDS = ("card", "visa", "mastercard", "amex", "account", "payment", "credit", "debit", "card number")
HASH_WORDS = ("commit", "hash", "sha", "sha1", "sha256", "md5", "checksum", "digest", "revision", "rev", "etag", "fingerprint", "blob", "tree", "object", "uuid", "guid", "build", "parent", "merge")
NUMBER_WORDS = ("version", "release", "isbn", "issn", "order", "invoice", "part", "lot", "no.", "nr", "number", "id", "ref", "article", "item", "model", "serial", "page", "date", "section", "chapter", "table", "score", "ratio")
ASSIGN = (" = ", "=", ": ", ":", " := ", " => ")
SLUG_WORDS = ("release", "notes", "long", "list", "guide", "part", "number", "the", "of", "docs", "archive", "summary", "report", "item", "chapter", "draft", "final", "with", "for", "section", "config", "module")

Plant = tuple[str, str, str, str | None]


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(string.digits) for _ in range(n))


def run(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def card_number(rng: random.Random, right: bool = True) -> str:
    """16 digits whose Luhn sum is 0 modulo 10, or is not."""
    body = [int(c) for c in rng.choice("3456") + digits(rng, 14)]
    total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(body))
    check = (-total) % 10
    return "".join(map(str, body)) + str(check if right else (check + rng.randint(1, 9)) % 10)


def fours(number: str, mark: str) -> str:
    return mark.join(number[i : i + 4] for i in range(0, len(number), 4))


def name(rng: random.Random) -> str:
    letters = run(rng, string.ascii_lowercase, rng.randint(2, 9))
    return letters + rng.choice(["", "", digits(rng, rng.randint(1, 3)), "." + run(rng, string.ascii_lowercase, 5)])


def address(rng: random.Random, at: str, dot: str) -> str:
    host = dot.join([run(rng, string.ascii_lowercase, rng.randint(3, 9)) + rng.choice(["", digits(rng, 1)]), *(["example"] * rng.randint(0, 1)), rng.choice(["org", "com", "net", "fr", "de", "es"])])
    return name(rng) + at + host


def octets(rng: random.Random, mark: str, high: int = 255) -> str:
    return mark.join(str(rng.randint(0, high)) for _ in range(4))


def hex_run(rng: random.Random) -> str:
    return run(rng, rng.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF"]), rng.choice([20, 24, 32, 32, 40, 40, 48, 64]))


def base64_run(rng: random.Random) -> str:
    return "a1" + run(rng, string.ascii_letters + string.digits + "+/" * rng.randint(0, 1), rng.choice([20, 30, 38, 42, 62]))


def prefixed(rng: random.Random) -> str:
    """Keys that issuers mark by how they begin."""
    mark, alphabet, n = rng.choice([
        ("sk_live_", string.ascii_letters + string.digits, 24), ("pk_test_", string.ascii_letters + string.digits, 24), ("ghp_", string.ascii_letters + string.digits, 36), ("glpat-", string.ascii_letters + string.digits, 20),
        ("AKIA", string.ascii_uppercase + string.digits, 16), ("xoxb-", string.digits, 12), ("AIza", string.ascii_letters + string.digits + "_-", 35), ("eyJ", string.ascii_letters + string.digits, 40),
    ])
    return mark + run(rng, alphabet, n - 2) + "7" + rng.choice(string.ascii_letters)


def slug(rng: random.Random) -> str:
    parts = [rng.choice(SLUG_WORDS) for _ in range(rng.randint(3, 6))]
    parts.insert(rng.randint(0, len(parts)), rng.choice(["2024", "v2", digits(rng, rng.randint(1, 4)), "version" + digits(rng, 2)]))
    return rng.choice("-_-/").join(parts)


def uuid(rng: random.Random) -> str:
    return "-".join(run(rng, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12))


def local_phone(rng: random.Random) -> str:
    a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
    return rng.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{rng.randint(10, 99)} {digits(rng, 2)} {digits(rng, 4)} {c}", f"0{rng.randint(10, 99)} {digits(rng, 4)} {c}"])


def after_word(rng: random.Random, words: tuple[str, ...]) -> str:
    word = rng.choice(words)
    return rng.choice([str.lower, str.upper, str.capitalize])(word) + rng.choice([" ", ": ", ":", " is ", " number ", " #", "="])


def assigned(rng: random.Random, words: tuple[str, ...]) -> tuple[str, str]:
    """What stands before and after a value that is given to a name."""
    mark = rng.choice(["", '"', "'"])
    owner = rng.choice(["", "my_", "db_", "APP_", "user "])
    return owner + rng.choice([str.lower, str.upper])(rng.choice(words)) + rng.choice(ASSIGN) + mark, mark


def neutral_name(rng: random.Random) -> str:
    return rng.choice(["x", "y", "value", "v1", "conf", "setting", "default"])


def right_email(rng: random.Random) -> Plant:
    at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), (" (at) ", ".")])
    return rng.choice(["", "", after_word(rng, CONTACT_WORDS)]), address(rng, at, dot), "", "email"


def wrong_email(rng: random.Random) -> Plant:
    word = lambda: run(rng, string.ascii_lowercase, rng.randint(2, 8))
    mark = rng.choice(["(at)", "[at]", "@"])
    return rng.choice(["", after_word(rng, CONTACT_WORDS)]), rng.choice([f"look {mark} this. Then", f"{word()} {mark} {word()}. {word().capitalize()}", f"{digits(rng, 2)} {mark} {digits(rng, 1)}.{digits(rng, 2)}", f"{word()} {mark} {digits(rng, 1)}.{digits(rng, 2)}"]), "", None


def right_ip(rng: random.Random) -> Plant:
    return after_word(rng, NETWORK_WORDS), octets(rng, rng.choice("-,:-")), "", "ip"


def wrong_ip(rng: random.Random) -> Plant:
    return rng.choice([
        ("", octets(rng, rng.choice(",:-")), "", None), (after_word(rng, NUMBER_WORDS), octets(rng, rng.choice(".,:-"), 30), "", None), (after_word(rng, NETWORK_WORDS), octets(rng, ".-"[rng.randint(0, 1)], 199) + digits(rng, 2), "", None),
        ("", f"{digits(rng, 4)}-{digits(rng, 2)}-{digits(rng, 2)}-{digits(rng, 2)}", "", None), ("", fours(card_number(rng, False), "."), "", None),
    ])


def right_card(rng: random.Random) -> Plant:
    number = card_number(rng)
    return rng.choice(["", after_word(rng, CARD_WORDS)]), fours(number, rng.choice("./")), "", "card"


def wrong_card(rng: random.Random) -> Plant:
    return rng.choice([
        (rng.choice(["", after_word(rng, CARD_WORDS), after_word(rng, NUMBER_WORDS)]), fours(card_number(rng, False), rng.choice(["", " ", "-", ".", "/"])), "", None), (after_word(rng, NUMBER_WORDS), digits(rng, rng.choice([12, 13, 14, 17, 18])), "", None),
        ("", f"{digits(rng, 4)}-{digits(rng, 2)}-{digits(rng, 2)} {digits(rng, 2)}.{digits(rng, 2)}.{digits(rng, 2)}", "", None), ("", "20" + digits(rng, 12), "", None),
    ])


def right_phone(rng: random.Random) -> Plant:
    a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
    if rng.random() < 0.4:
        return rng.choice(["", after_word(rng, CONTACT_WORDS)]), f"({a}) {b}-{c}", "", "phone"
    return after_word(rng, CONTACT_WORDS), local_phone(rng), "", "phone"


def wrong_phone(rng: random.Random) -> Plant:
    return rng.choice([
        (rng.choice(["", after_word(rng, NUMBER_WORDS)]), local_phone(rng), "", None), ("", f"{digits(rng, 4)}-{digits(rng, 2)}-{digits(rng, 2)} {digits(rng, 2)}", "", None), (after_word(rng, NUMBER_WORDS), digits(rng, rng.randint(7, 15)), "", None),
        ("", "-".join(digits(rng, n) for n in (3, 1, 4, 4, 1)), "", None), ("(", f"{digits(rng, 4)}-{digits(rng, 4)}", ")", None), (after_word(rng, CARD_WORDS), card_number(rng, False), "", None), (after_word(rng, HASH_WORDS), digits(rng, rng.randint(7, 12)), "", None),
    ])


def right_secret(rng: random.Random) -> Plant:
    value = rng.choice([hex_run, hex_run, base64_run, prefixed])(rng)
    kind = rng.random()
    if kind < 0.25:
        return rng.choice(["", after_word(rng, SECRET_WORDS)]), prefixed(rng), "", "secret"
    if kind < 0.4:
        return neutral_name(rng) + rng.choice(ASSIGN) + '"', value, '"', "secret"
    before, after = assigned(rng, SECRET_WORDS)
    return before, value, after, "secret"


def wrong_secret(rng: random.Random) -> Plant:
    before, after = assigned(rng, HASH_WORDS)
    return rng.choice([
        (after_word(rng, HASH_WORDS), hex_run(rng), "", None), (before, rng.choice([hex_run, base64_run, uuid])(rng), after, None), ("", uuid(rng), "", None), (rng.choice(["", "id=", "id: ", "see "]), slug(rng), "", None),
        (rng.choice(["/", "https://host.example.org/", "www.example.com/", "./"]), slug(rng) + rng.choice(["", ".html", "/index"]), "", None), ("", "".join(w.capitalize() for w in rng.choices(SLUG_WORDS, k=4)) + digits(rng, 2), "", None),
        (rng.choice(["", after_word(rng, NUMBER_WORDS)]), digits(rng, rng.randint(16, 20)), "", None), (rng.choice(["href=", 'src="', "url: ", "path = "]), "/" + slug(rng), "", None), (rng.choice(SECRET_WORDS) + " ", slug(rng), "", None),
    ])


MAKERS: list[tuple[Callable[[random.Random], Plant], Callable[[random.Random], Plant]]] = [
    (right_email, wrong_email), (right_ip, wrong_ip), (right_card, wrong_card), (right_phone, wrong_phone), (right_secret, wrong_secret),
]


def plants(rng: random.Random) -> list[Plant]:
    """One for each kind, right or wrong."""
    return [(right if rng.random() < 0.5 else wrong)(rng) for right, wrong in MAKERS]


def place(rng: random.Random, text: str, width: int) -> tuple[str, str]:
    """What stands on both sides of a place between two words of the text."""
    if not text:
        return "", ""
    at = rng.randrange(len(text) + 1)
    cut = next((i for i in range(at, min(len(text), at + 60)) if text[i].isspace()), len(text) if at + 60 >= len(text) else at)
    return text[max(0, cut - width) : cut] + " ", " " + text[cut + 1 : cut + 1 + width]
