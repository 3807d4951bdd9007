"""Personal data in whole texts: expressions propose spans, checksums confirm them, words nearby adjust the score.

Every kind proposes spans by an expression, leftmost first and not overlapping, in time
linear in the text. A validator may drop a span (Luhn and mod-97 checksums, parts of an
address, numbers of digits); what it covered stays used up. A span starts from its
kind's score, which its checksum has raised; words near it that name the kind add to
it, words that name something else take away. Base kinds are kept whatever their score, other kinds
from ``LEAST_SCORE`` on: those without a checksum need a word that names them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import texts

LEAST_SCORE = 0.5
NAMED, MISNAMED = 0.4, -0.3
# Characters looked at before and after a span for words.
BEFORE, AFTER = 60, 30

FOUND = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, scores array<double>"

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, digits summed, a multiple of ten."""
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def mod97(code: str) -> bool:
    """The checksum of bank account numbers: the first four characters last, letters as 10 to 35, one more than a multiple of 97."""
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """From every ``@``: the local part is all that fits before it, back to the span before, so no place is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1) if at > done and text[at - 1] in _LOCAL else None
        if domain:
            start = at - 1
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def addresses(text: str) -> Iterator[Span]:
    """Four numbers at a time of every run of numbers with single dots; parts above 255 fail."""
    if "." not in text:
        return
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def matching(expression: str, valid: Callable[[str], bool]) -> Callable[[str], Iterator[Span]]:
    compiled = re.compile(expression)

    def propose(text: str) -> Iterator[Span]:
        return (m.span() for m in compiled.finditer(text) if valid(m[0]))

    return propose


@dataclass(frozen=True)
class Kind:
    """``needs`` is a character a text must hold for a span of this kind; ``words`` name the kind, ``others`` something else."""

    name: str
    propose: Callable[[str], Iterator[Span]]
    score: float
    words: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    needs: str = ""


# Words near numbers in English, German, French and Spanish.
PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "telefon", "handy", "anruf", "téléphone", "portable", "appel", "teléfono", "móvil", "llame")
CARD_WORDS = ("card", "visa", "mastercard", "amex", "credit", "debit", "kreditkarte", "karte", "carte", "tarjeta")
EMAIL_WORDS = ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel")
IP_WORDS = ("ip", "address", "host", "server", "adresse", "dirección")
IBAN_WORDS = ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer")
SSN_WORDS = ("ssn", "social security", "social-security")
BIRTH_WORDS = ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "née", "né le", "naissance", "nacido", "nacida", "nacimiento")
PASSPORT_WORDS = ("passport", "reisepass", "passeport", "pasaporte")
NUMBER_WORDS = ("order", "invoice", "version", "serial", "isbn", "part no", "tracking", "bestellung", "rechnung", "commande", "facture", "pedido", "factura")

BASE_KINDS = (
    Kind("email", emails, 0.9, EMAIL_WORDS, needs="@"),
    Kind("ip", addresses, 0.6, IP_WORDS, ("version", "release", "v."), needs="."),
    Kind(
        "card",
        matching(r"[0-9](?:[\x20-]?[0-9])++", lambda s: len(s) >= 14 and 14 <= len(_digits(s)) <= 19 and luhn(_digits(s))),
        0.7, CARD_WORDS, NUMBER_WORDS,
    ),
    Kind("phone", matching(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(_digits(s)) <= 15), 0.7, PHONE_WORDS, NUMBER_WORDS, needs="+"),
)
MORE_KINDS = (
    Kind(
        "iban",
        matching(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda s: 15 <= len(s.replace(" ", "")) <= 34 and mod97(s.replace(" ", ""))),
        0.8, IBAN_WORDS,
    ),
    Kind("ssn", matching(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda s: True), 0.3, SSN_WORDS, NUMBER_WORDS, needs="-"),
    Kind("local_phone", matching(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda s: True), 0.3, PHONE_WORDS, NUMBER_WORDS),
    Kind("birth_date", matching(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])", lambda s: True), 0.2, BIRTH_WORDS, NUMBER_WORDS),
    Kind("passport", matching(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", lambda s: True), 0.2, PASSPORT_WORDS, NUMBER_WORDS),
)

_HINT = re.compile(r"[0-9@]")


class Context:
    """Finds a kind's words near a span: whole words, whatever their case."""

    def __init__(self, kinds: Sequence[Kind]):
        self.named = [self._words(k.words) for k in kinds]
        self.misnamed = [self._words(k.others) for k in kinds]

    @staticmethod
    def _words(words: tuple[str, ...]) -> re.Pattern | None:
        return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")s?(?!\w)", re.IGNORECASE) if words else None

    def change(self, kind: int, text: str, start: int, end: int) -> float:
        near = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
        out = 0.0
        if self.named[kind] and self.named[kind].search(near):
            out += NAMED
        if self.misnamed[kind] and self.misnamed[kind].search(near):
            out += MISNAMED
        return out


def spans_of(kinds: Sequence[Kind], base: int, context: Context, text: str) -> list[tuple[int, int, int, float]]:
    """``start, kind, end, score`` by start, then kind.

    The first ``base`` kinds are kept whatever their score; a span of another kind that meets one of theirs is not listed.
    """
    if not _HINT.search(text):
        return []
    out: list[tuple[int, int, int, float]] = []
    first: list[Span] = []
    for k, kind in enumerate(kinds):
        if k == base:
            first = sorted((s, e) for s, _, e, _ in out)
        if kind.needs and kind.needs not in text:
            continue
        for start, end in kind.propose(text):
            before = bisect_left(first, (end, 0)) - 1
            if before >= 0 and max(e for _, e in first[max(0, before - base) : before + 1]) > start:
                continue
            score = round(min(1.0, max(0.0, kind.score + context.change(k, text, start, end))), 6)
            if k < base or score >= LEAST_SCORE:
                out.append((start, k, end, score))
    return sorted(out)


def find_personal_data(docs: DataFrame, more: Sequence[Kind] = MORE_KINDS) -> DataFrame:
    """``doc_id, kinds, starts, ends, scores`` of every row of ``docs``: its spans in code points, end exclusive.

    Spans come by start, then in the order of the kinds (base kinds first). Kinds are independent and may overlap. Null and
    empty texts, and texts without personal data, have empty lists. Repeated rows give repeated rows; an empty table gives none.
    """
    kinds = (*BASE_KINDS, *more)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context(kinds)
        for batch in batches:
            lists: list[list[list]] = [[], [], [], []]
            for text in batch.column(1):
                found = spans_of(kinds, len(BASE_KINDS), context, text.as_py())
                lists[0].append([kinds[k].name for _, k, _, _ in found])
                lists[1].append([s for s, _, _, _ in found])
                lists[2].append([e for _, _, e, _ in found])
                lists[3].append([v for _, _, _, v in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, f.type) for x, f in zip(lists, list(schema)[1:], strict=True)]], schema=schema
            )

    return texts(docs).mapInArrow(scan, FOUND)


def masked(docs: DataFrame, least: float = LEAST_SCORE, more: Sequence[Kind] = MORE_KINDS) -> DataFrame:
    """``doc_id, text`` with every span of at least this score replaced by its kind in angle brackets.

    Of overlapping spans the one that begins first is replaced, of those the first kind. A null text stays null.
    """
    kinds = (*BASE_KINDS, *more)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context(kinds)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text, parts, at = value.as_py(), [], 0
                for start, k, end, score in spans_of(kinds, len(BASE_KINDS), context, text) if text else ():
                    if start >= at and score >= least:
                        parts += [text[at:start], f"<{kinds[k].name}>"]
                        at = end
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(mask, "doc_id long, text string")
