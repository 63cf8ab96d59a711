"""Personal data by candidate gradient boosting: generators propose, boosted trees judge, thresholds select.

Base spans (e-mail, IP, card and phone by fixed patterns and checks) are always reported. Beside them, wide
generators propose spans that may overlap each other: anything like a mail address (also spelled out),
runs of dotted or coloned numbers, long digit runs with separators and the card-like groups in them, phone-like groups,
long mixed tokens (keys, passwords), and whatever stands after a key word with ':' or '=', at any length and with any
punctuation. A single word of letters after a key word counts as a secret when it is quoted, joined by '=', long or
of mixed case, or ends its clause ("password: required for all" is none). Each candidate has format features (length, shares of digits, letters, hex, distinct
characters, entropy, groups, checksum) and context features (characters before and after, key words in the
words before). Boosted trees of depth ``DEPTH``, one model per kind, on the binned features give a probability, and a threshold per
kind, the lowest with the wanted precision on a calibration fold, selects the spans that are added. Of
overlapping selections the more probable one stays, and none overlaps a base span.

The trees are fitted on what they judge: candidates that touch no base span. Labels come from evidence other than the
base patterns (``strict``): a spelled-out address with a known top-level domain, the grouping of national phone numbers
or a dialling word before the number, valid IPv6 and hardware addresses and IPv4 with written dots, check digit with the
issuer's prefix, keys after key words. Every base span is rewritten in its place without '+', '@' or country code, as
IPv6 or as a shorter card (``rewritten``), a further positive; for each positive a damaged copy in the same context
(another check digit, a part out of range, letters for digits) is a further negative, so that the trees learn the form
and not the place. They are fitted on the distinct candidates of all texts, so that copies count once, and on fixed sentences (``primers``),
so that each kind has a threshold on every table. The candidates stay with the tasks, binned, in blocks: for each level of the trees Spark adds up
their histograms, and the driver sees these sums, the counts behind the bins' edges and the counts of the calibration fold by probability,
none of which grows with the table. Slopes are rounded to a power of two, so that sums are exact and the trees do not depend on the order of the rows.

Edge cases: NULL and empty texts have no spans; positions are code points, ends exclusive; equal texts have equal spans; rows with an equal ``doc_id`` are searched each; further columns
are ignored (``find``) or kept (``redact``).
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import map_texts, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_like", "net_like", "card_like", "phone_like", "secret")
DEPTH = 3
#: Trees of a kind.
ROUNDS = 120
#: Positives of a kind in the calibration fold from which on the primers do not count there.
OWN_POSITIVES = 50
#: Bins of a feature, candidates of a block, and trees after which the blocks keep their log odds.
BINS = 32
BLOCK_ROWS = 50_000
SETTLE = 10
#: Cells of a unit of log odds in the calibration.
CELLS = 1024

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Only from the start of a run of digits, and whole runs: what fails or ends there does so from each digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORTH = re.compile(r"[0-9@]").search

_AT = re.compile(r"( ?(?:@|\(at\)|\[at\]) ?| at )([\w-]{1,63}(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]{1,63})+)", re.I)
_NAME = re.compile(r"[\w.%+-]+\Z")
_GROUPED_PHONE = (
    r"(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|00[1-9][0-9]{0,2}(?:[ .-]\(?[0-9]{2,}\)?){2,5}"
)
_DIGITS = {
    "net_like": (
        re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}"),
        re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}"),
    ),
    "card_like": (
        re.compile(r"[0-9](?:[ -]?[0-9]){11,22}"),
        re.compile(r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|[0-9]{13,19})(?![0-9])"),
    ),
    "phone_like": (
        re.compile(r"[+(]{0,2}[0-9][0-9 ().-]{6,20}[0-9]"),
        re.compile(r"(?<![0-9A-Za-z+.-])(?:" + _GROUPED_PHONE + r")(?![0-9A-Za-z])"),
    ),
    "secret": (
        re.compile(r"[A-Za-z0-9+/_-]{14,}"),
        re.compile(r"(?<![A-Za-z0-9+/_.!$=~-])[A-Za-z0-9+/_-]+(?:[.!$=~]+[A-Za-z0-9+/_-]+)+[!$=]*"),
    ),
}
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){1,6}:[0-9A-Fa-f]{1,4}(?!\w|:\w)")
_KEY_WORD = (
    r"(?P<strong>pass(?:word|wd|wort|phrase|code)|pwd|token|secret|(?:api|access|private|client|auth)[ _-]?key|contraseña|mot de passe|kennwort)"
    r"|(?<![a-z])(?:pass|key|auth(?:orization|entication)?|clave)"
)
_ASSIGN = r"""["'`]?(?:(?P<assign>[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+is[ \t]+)|[ \t]+%s)(?:(?:bearer|basic)[ \t]+)?"""
_KEYED = re.compile("(?i)(?:" + _KEY_WORD + ")" + _ASSIGN % r"(?=\S{14})" + r"""(?:"([^"\n]{3,})"|'([^'\n]{3,})'|`([^`\n]{3,})`|["'`]?([^\s"'`]{3,}))""")
_KEYED_BEFORE = re.compile("(?i)(?:" + _KEY_WORD + ")" + _ASSIGN % "" + r"""["'`]?\Z""")
_KEY_PARTS = ("pass", "pwd", "token", "secret", "key", "auth", "contraseña", "clave", "kennwort")
_KEYS = re.compile(r"(?i)(pass(?:word|wd)?|token|secret|api|key|auth)")
_REACH = re.compile(r"(?i)(mail|phone|tel|call|card|visa|account|address|host|ip)")
_MAIL = re.compile(r"([\w.%+-]{1,64})( ?(?:@|\(at\)|\[at\]) ?| at )([\w-]+(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]+)+)", re.I)
_DOT = re.compile(r" \. |\.| ?\(dot\) ?| ?\[dot\] ?| dot ", re.I)
_TLDS = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev eu de fr es uk us ca au nz ie ch at it nl be lu pt pl cz sk hu ro bg gr dk se no fi ee "
    "lv lt ru ua tr il in cn jp kr tw hk sg br ar mx cl pe za me tv cat online site shop blog cloud tech example test".split()
)
_FUNCTION_WORDS = frozenset("the a an this that these those it is at my your our their his her its all any some no one and or of to in on look looking".split())
_MAIL_WORD = re.compile(r"(?i)(mail|contact|write|reach|send|address|adresse|schreib|courriel|correo|contacto)")
_DIAL = re.compile(r"(?i)\b(phone|tel|t[ée]l[ée]phone|telef|call|cell|mobil|móvil|portable|fax|dial|whatsapp|sms|handy|anruf|appel|llam)\w*\W{0,3}(?:\w+\W{1,2}){0,2}\Z")
_NATIONAL = re.compile(_GROUPED_PHONE)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}")
_WRITTEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}")
_ISSUER = re.compile(r"4(?:.{12}|.{15}|.{18})|5[1-5].{14}|2[2-7].{14}|3[47].{13}|3(?:0[0-5]|[689].).{11}|35.{14}|6(?:011|5..|4[4-9].).{12,15}")
_CARD_WORD = re.compile(r"(?i)(card|visa|amex|american express|master|diners|karte|carte|tarjeta|pay|credit|kredit)")
_STRICT_SECRET = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{16,64}|[A-Za-z0-9+/_-]{20,64}")
_DOTTED = re.compile(r"[A-Za-z0-9+/_-]+(?:[.!$=~]+[A-Za-z0-9+/_-]+)+[!$=]*")
_FILE = re.compile(r"\.[a-z]{2,4}\Z")
_NO_VALUE = re.compile(
    r"(?i)(?:required|none|null|nil|true|false|undefined|empty|missing|wrong|incorrect|invalid|expired|value|string|optional|here|yes|no|please|enter|reset|forgot(?:ten)?|changed|your"
    r"|the|is|must|should|may|can|not|\*+|x+|\.+)\Z|[<{\[(]|\$[{(]|%[({]|https?://|[A-Za-z_][\w.]*\("
)
_ASSIGN_INSIDE = re.compile(r"(?i)\w*(?:pass|pwd|token|secret|key|auth|clave|kennwort)\w*=")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 16 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost address matches; looks only around each ``@``."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        first = at
        while first > end:  # widen backwards in steps, so that a long run costs its length once
            begin = max(end, first - 64)
            run = _LOCAL.search(text[begin:first])
            if not run:
                break
            first = begin + run.start()
            if run.start():
                break
        if first < at:
            out.append((first, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind and start."""
    if not _WORTH(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m.group())]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators, each once; they may overlap."""
    out = []
    lower = text.lower()
    if any(x in lower for x in ("@", "(at)", "[at]", " at ")):
        for m in _AT.finditer(text):
            first = max(0, m.start() - 64)
            if name := _NAME.search(text[first : m.start()]):
                out.append(("mail_like", first + name.start(), m.end()))
    if text.count(":") > 1:
        out += [("net_like", *m.span()) for m in _COLONS.finditer(text)]
    if _WORTH(text):
        for kind, patterns in _DIGITS.items():
            for pattern in patterns:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if kind != "secret" or m.end() - m.start() >= 14 and _mixed(m.group())]
    if any(x in lower for x in _KEY_PARTS) or "mot de passe" in lower:
        for m in _KEYED.finditer(text):
            a, b = next(m.span(i) for i in range(m.lastindex, 0, -1) if m.group(i))
            if a and text[a - 1] not in "\"'`" or text[b : b + 1] != text[a - 1]:
                b = a + len(text[a:b].rstrip(".,;:)]}>"))
            if b - a >= 3:
                out.append(("secret", a, b))
    return list(dict.fromkeys(out))


def _mail(span: str, before: str) -> bool:
    """An address whose '@' or dots are written otherwise, with a known top-level domain."""
    m = _MAIL.fullmatch(span)
    if not m:
        return False
    local, at, domain = m.groups()
    labels = _DOT.split(domain.lower())
    if labels[-1] not in _TLDS or any(x in _FUNCTION_WORDS for x in labels[:-1]) or local.lower() in _FUNCTION_WORDS or not any(map(str.isalpha, local)):
        return False
    if at == " @":  # a mention
        return False
    # "at" between plain dots is an address only with more evidence ("meet at example.com")
    return at.lower() != " at " or bool(re.search(r"dot\b", domain, re.I)) or bool(re.search(r"[0-9._-]", local) or _MAIL_WORD.search(before[-24:]))


def _is_ip6(text: str) -> bool:
    if text.count(":") < 2 or "." in text:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len([g for g in text.split(":") if g]) >= 3 or bool(re.match(r"(?i)fe[89ab].:|f[cd]..:|[23]...:", text))


def _net(span: str) -> bool:
    return _is_ip6(span) or bool(_MAC.fullmatch(span)) or bool(_WRITTEN_IP.fullmatch(span)) and all(int(p) <= 255 for p in re.findall(r"[0-9]+", span))


def _phone(span: str, before: str) -> bool:
    """The groups of a national number or one with 00, or a dialling word before seven to thirteen digits."""
    digits = _digits(span)
    if _NATIONAL.fullmatch(span):
        return len(digits) <= 15
    if _NATIONAL.match(span) or _DATE.match(span) or _IP.fullmatch(span) or span.startswith("+"):
        return False
    return 7 <= len(digits) <= 13 and span.count("(") == span.count(")") and bool(_DIAL.search(before))


def _card(span: str, before: str) -> bool:
    """A right check digit, and the length of the base or the prefix and length of an issuer."""
    digits = _digits(span)
    if not 13 <= len(digits) <= 19 or not luhn(digits):
        return False
    # 13 and 14 digits are also article numbers and times
    return len(digits) >= 16 or bool(_ISSUER.fullmatch(digits)) and (len(digits) == 15 or len(digits) < len(span) or bool(_CARD_WORD.search(before)))


def _secret(span: str, before: str, after: str) -> bool:
    """A value after a key word, or a long mixed token near one."""
    if _NO_VALUE.match(span):
        return False
    letters, digits = any(c.isalpha() for c in span), any(c.isdigit() for c in span)
    marks = any(c in "!$#%&*+=?@^~" for c in span)
    key = _KEYED_BEFORE.search(before)
    if key and key["assign"]:
        strong, quoted = key["strong"] is not None, before[-1] in "\"'`"
        if letters and digits or marks and (letters or digits):
            return len(span) >= (4 if strong else 6)
        if digits:
            return key[0][:1] in "pPcCkKmM" and strong and len(span) >= 4
        inner = any(c.isupper() for c in span[1:]) and any(c.islower() for c in span)
        ends = not re.match(r"[ \t]+\w", after)
        return letters and (strong and (quoted or "=" in key["assign"] or inner or ":" in key["assign"] and (len(span) >= 12 or ends)) or inner and len(span) >= 14)
    if _ASSIGN_INSIDE.match(span):
        return False
    if span.startswith("AKIA") and _STRICT_SECRET.fullmatch(span):
        return True
    near = bool(_KEYS.search(before[-24:]))
    inner = any(c.isupper() for c in span[1:]) and any(c.islower() for c in span)
    return near and bool(_STRICT_SECRET.fullmatch(span) and (digits or inner) or len(span) >= 14 and letters and digits and _DOTTED.fullmatch(span) and not _FILE.search(span))


def strict(kind: str, span: str, before: str, after: str = "") -> bool:
    """Whether form and context of a candidate are evidence of its kind (the label of the fit)."""
    if kind == "mail_like":
        return _mail(span, before)
    if kind == "net_like":
        return _net(span)
    if kind == "card_like":
        return _card(span, before)
    if kind == "phone_like":
        return _phone(span, before)
    return _secret(span, before, after)


def damaged(kind: str, span: str) -> str:
    """A copy that only looks like its kind."""
    if kind == "mail_like":
        return re.sub(r"[\w-]+\Z", "x0", span)
    if kind == "net_like":
        if ":" in span:
            return span.replace("::", ":") if "::" in span else span.rpartition(":")[0]
        return re.sub(r"[0-9]+\Z", lambda m: str(int(m.group()) + 256), span)
    if kind == "card_like":
        last = max(i for i, c in enumerate(span) if c.isdigit())
        return span[:last] + str((int(span[last]) + 1) % 10) + span[last + 1 :]
    if kind == "phone_like":
        return span + "0" * 9
    return "".join("abcdefghij"[int(c)] if c.isdigit() else c for c in span)


def rewritten(kind: str, span: str) -> list[tuple[str, str]]:
    """Kind and text of what a base span would be without the signs the base patterns need."""
    if kind == "email":
        local, _, domain = span.rpartition("@")
        spelled = domain.replace(".", " dot ")
        return [("mail_like", t) for t in (f"{local} (at) {domain}", f"{local} at {spelled}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} @ {domain}")]
    digits = _digits(span)
    if kind == "phone":
        d = digits[-10:].rjust(10, "2")
        d = "".join("2" if i in (0, 3) and c in "01" else c for i, c in enumerate(d))
        return [("phone_like", t) for t in (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")]
    if kind == "ip":
        h = hashlib.md5(span.encode()).hexdigest()
        groups = [h[i : i + 4].lstrip("0") or "0" for i in range(0, 32, 4)]
        return [("net_like", span.replace(".", "[.]")), ("net_like", ":".join(groups)), ("net_like", f"2001:db8:{groups[0]}::{groups[1]}")]
    short = "37" + digits[2:14]
    short += next(c for c in "0123456789" if luhn(short + c))
    return [("card_like", short), ("card_like", f"{short[:4]} {short[4:10]} {short[10:]}")]


FEATURES = (
    *(f"is_{k}" for k in ADDED), "length", "digits", "letters", "uppers", "hexes", "others", "distinct", "entropy", "groups", "longest_run",
    "checksum", "parts_fit", "plus", "at", "before_class", "after_class", "key_word", "reach_word", "assigned", "line_start",
    "known_domain", "spelled_dot", "word_at", "function_words", "mail_word", "dial_word", "national", "trunk", "date", "ip6", "mac", "written_ip", "issuer", "card_word", "open_brackets", "mention", "marked_name",
    "keyed", "by_equals", "quoted", "marks", "inner_case", "no_value", "followed", "assign_inside", "long_run", "dotted_run", "file_end", "akia", "pass_like",
)


def _kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate."""
    digits = _digits(span)
    n = len(span)
    counts = np.unique(np.array(list(span)), return_counts=True)[1] / n
    groups = re.findall(r"[0-9]+", span)
    mail = _MAIL.fullmatch(span) if kind == "mail_like" else None
    labels = _DOT.split(mail.group(3).lower()) if mail else []
    key = _KEYED_BEFORE.search(before) if kind == "secret" else None
    return [
        *(float(kind == k) for k in ADDED),
        n, len(digits), sum(c.isalpha() for c in span), sum(c.isupper() for c in span), sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        sum(not c.isalnum() for c in span), len(counts), float(-(counts * np.log2(counts)).sum()), len(groups), max(map(len, groups), default=0),
        float(bool(digits) and luhn(digits)), float(all(int(g) < 256 for g in groups if len(g) < 9) and len(groups) == 4), float(span[0] == "+"), float("@" in span),
        _kind_of(before[-1:]), _kind_of(after[:1]), float(bool(_KEYS.search(before[-24:]))), float(bool(_REACH.search(before[-24:]))),
        float(bool(re.search(r"[=:]\s*[\"']?\Z", before))), float(not before or before[-1] == "\n"),
        float(bool(labels) and labels[-1] in _TLDS), float(bool(mail and re.search(r"dot\b", mail.group(3), re.I))), float(bool(mail) and mail.group(2).lower() == " at "),
        float(bool(mail) and (mail.group(1).lower() in _FUNCTION_WORDS or any(x in _FUNCTION_WORDS for x in labels[:-1]))), float(bool(_MAIL_WORD.search(before[-24:]))),
        float(bool(_DIAL.search(before))), float(2 * bool(_NATIONAL.fullmatch(span)) or bool(_NATIONAL.match(span))), float(span[0] == "0"), float(bool(_DATE.match(span))),
        float(_is_ip6(span)), float(bool(_MAC.fullmatch(span))), float(bool(_WRITTEN_IP.fullmatch(span))), float(bool(_ISSUER.fullmatch(digits))), float(bool(_CARD_WORD.search(before))),
        float(span.count("(") != span.count(")")), float(bool(mail) and mail.group(2) == " @"), float(bool(mail and re.search(r"[0-9._-]", mail.group(1)))),
        float(0 if not key or not key["assign"] else 1 + (key["strong"] is not None)), float(bool(key) and "=" in (key["assign"] or "")), float(before[-1:] in ("'", '"', "`")),
        sum(c in "!$#%&*+=?@^~" for c in span), float(any(c.isupper() for c in span[1:]) and any(c.islower() for c in span)), float(bool(_NO_VALUE.match(span))),
        float(bool(re.match(r"[ \t]+\w", after))), float(bool(_ASSIGN_INSIDE.match(span))), float(bool(_STRICT_SECRET.fullmatch(span))), float(bool(_DOTTED.fullmatch(span))),
        float(bool(_FILE.search(span))), float(span.startswith("AKIA")), float(bool(key) and key[0][:1] in "pPcCkKmM"),
    ]


@dataclass
class Trees:
    """Boosted trees: ``edges`` of the bins by feature; a tree is (feature, bin) per inner node and a value per leaf."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bins by feature and row."""
        return np.array([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return settled(self.binned(x), np.full(len(x), self.start), self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x))) if len(x) else np.zeros(0)

    def split(self, level: int, sums: np.ndarray, rate: float, ridge: float) -> None:
        """Choose the cuts of a level of the last tree, and after the last level its values."""
        which, cut, value = self.trees[-1]
        for place in range(2**level):
            k, best, (all_g, all_h) = 2**level - 1 + place, 1e-6, sums[:, place, -1]
            left, first = (all_g, all_h), 0  # without a cut all go left
            for i, edges in enumerate(self.edges):
                last = first + len(edges) + 1
                g, h = np.cumsum(sums[0, place, first:last]), np.cumsum(sums[1, place, first:last])
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                if gain.max() > best:
                    best, which[k], cut[k] = gain.max(), i, gain.argmax()
                    left = g[cut[k]], h[cut[k]]
                first = last
            if level == DEPTH - 1:
                value[2 * place] = -rate * left[0] / (left[1] + ridge)
                value[2 * place + 1] = -rate * (all_g - left[0]) / (all_h - left[1] + ridge)


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _place(b: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """Where the rows stand after so many levels, from the left."""
    which, cut, _ = tree
    place = np.zeros(b.shape[1], np.int64)
    for level in range(levels):
        nodes = range(2**level - 1, 2 ** (level + 1) - 1)
        place = 2 * place + np.choose(place, [b[which[k]] > cut[k] for k in nodes])
    return place


def settled(b: np.ndarray, total: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """The log odds of binned rows with those of further trees."""
    total = total.copy()
    for tree in trees:
        total += tree[2][_place(b, tree, DEPTH)]
    return total


def histograms(b: np.ndarray, good: np.ndarray, total: np.ndarray, trees: list[Tree], widths: list[int], level: int) -> np.ndarray:
    """Sums of slope and bend by node of a level of the last tree and bin of each feature, and at the end over all bins."""
    p = 1 / (1 + np.exp(-settled(b, total, trees[:-1])))
    place, scale = _place(b, trees[-1], level), float(1 << 26)
    out = []
    for weights in (np.rint((p - good) * scale) / scale, np.rint(p * (1 - p) * scale) / scale):
        whole = np.bincount(place, weights, 1 << level)[:, None]
        out.append(np.hstack([*(np.bincount(place * w + b[i], weights, w << level).reshape(-1, w) if w > 1 else whole for i, w in enumerate(widths)), whole]))
    return np.array(out)


def grow(models: dict[str, Trees], sums: Callable[[int], dict[str, np.ndarray]], *, rounds: int, rate: float = 0.2, ridge: float = 1.0) -> Iterator[int]:
    """Newton boosting on the log loss with histogram splits: ``sums`` gives the histograms of a level by kind. Yields after each tree."""
    inner = 2**DEPTH - 1
    for done in range(rounds):
        for model in models.values():
            model.trees.append((np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(inner + 1)))
        for level in range(DEPTH):
            for kind, found in sums(level).items():
                models[kind].split(level, found, rate, ridge)
        yield done + 1


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The distinct inner quantiles, below the last value, of ascending ``values`` that occur ``counts`` times."""
    at = np.linspace(0, 1, bins + 1)[1:-1] * (counts.sum() - 1)
    until = np.cumsum(counts)
    low, high = (values[np.searchsorted(until, f(at), "right")] for f in (np.floor, np.ceil))
    edges = np.unique(low + (high - low) * (at - np.floor(at)))
    return edges[edges < values[-1]]


def _started(edges: list[np.ndarray], good: float, rows: float) -> Trees:
    share = np.clip(good / rows, 1e-4, 1 - 1e-4)
    return Trees(edges, [], float(np.log(share / (1 - share))))


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """``grow`` over one block."""
    model = _started([edges_of(*np.unique(x[:, i], return_counts=True)) for i in range(x.shape[1])], y.sum(), len(y))
    b, total = model.binned(x), np.full(len(y), model.start)
    widths = [len(e) + 1 for e in model.edges]
    for _ in grow({"": model}, lambda level: {"": histograms(b, y, total, model.trees, widths, level)}, rounds=rounds, rate=rate, ridge=ridge):
        pass
    return model


@dataclass
class Detector:
    """Trees and threshold by kind."""

    trees: dict[str, Trees]
    thresholds: dict[str, float]

    def probability(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for kind in np.unique(kinds):
            out[kinds == kind] = self.trees[kind].probability(x[kinds == kind])
        return out

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Selected candidates beside the base spans, by kind and start."""
        free = [c for c in candidates(text) if c[0] in self.thresholds and not any(a < c[2] and c[1] < b for _, a, b in base)]
        if not free:
            return []
        rows = np.array([features(k, text[a:b], text[max(0, a - 32) : a], text[b : b + 8]) for k, a, b in free], float)
        chosen: list[tuple[str, int, int]] = []
        ranked = sorted((-p, a, b, k) for (k, a, b), p in zip(free, self.probability(np.array([c[0] for c in free]), rows)) if p >= self.thresholds[k])
        taken: list[tuple[int, int]] = []
        for _, a, b, k in ranked:
            if not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                chosen.append((k, a, b))
        return sorted(chosen, key=lambda s: (ADDED.index(s[0]), s[1]))

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and added spans."""
        base = base_spans(text)
        return base, self.added(text, base)


def calibrate(kinds: np.ndarray, p: np.ndarray, y: np.ndarray, precision: float, *, n: np.ndarray | None = None, top: np.ndarray | None = None) -> dict[str, float]:
    """Per kind the lowest threshold from which on the selections have at least ``precision``; kinds without one are absent.

    The threshold lies midway between the last selected probability and the next one, as new
    candidates scatter around those seen here. An entry may stand for ``n`` candidates, ``y`` of them
    good, with probabilities from ``p`` to ``top``.
    """
    n, top = np.ones(len(p)) if n is None else n, p if top is None else top
    out = {}
    for kind in ADDED:
        own = kinds == kind
        if not y[own].sum():
            continue
        order = np.argsort(-p[own], kind="stable")
        ranked, tops, right, seen = p[own][order], top[own][order], np.cumsum(y[own][order]), np.cumsum(n[own][order])
        last = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True))  # equal probabilities go together
        fine = last[right[last] / seen[last] >= precision]
        if len(fine):
            following = tops[fine[-1] + 1] if fine[-1] + 1 < len(ranked) else 0.0
            out[kind] = float(ranked[fine[-1]] + following) / 2
    return out


def labelled(text: str) -> list[tuple[str, int, list[float]]]:
    """Kind, label and features of the candidates beside the base spans, of rewritten base spans and of damaged copies."""
    base = base_spans(text)
    found = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
    spans = [(k, text[a:b], a, b) for k, a, b in found] + [(k, t, a, b) for kind, a, b in base for k, t in rewritten(kind, text[a:b])]
    rows = []
    for kind, span, a, b in spans:
        before, after = text[max(0, a - 32) : a], text[b : b + 8]
        good = strict(kind, span, before, after)
        rows.append((kind, int(good), features(kind, span, before, after)))
        if good and (bad := damaged(kind, span)) and not strict(kind, bad, before, after):
            rows.append((kind, 0, features(kind, bad, before, after)))
    return rows


def primers() -> list[str]:
    """Fixed sentences with every kind written beside the base patterns, and with things that only look like it."""
    rng = random.Random(128)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    places = ("", "and then ", "call ", "Tel. ", "mail ", "contact: ", "card ", "host ", "the words before it, ", "wir haben ", "nous avons ", "line\n")
    names, hosts, tops = ("bob", "ann.lee", "max_7", "info", "marie-42"), ("example", "mail3.acme", "uni-koeln", "post"), ("com", "org", "de", "fr", "es", "co.uk")
    texts = []
    for i in range(240):
        a, b, host = rng.choice(places), rng.choice(("", " and more", ", or", ".", "\n")), f"{rng.choice(hosts)}.{rng.choice(tops)}"
        phone = f"+1 ({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)}"
        card = rng.choice(("4", "51", "37", "6011")) + digits(11)
        card += next(c for c in "0123456789" if luhn(card + c))
        base = (f"{rng.choice(names)}{rng.choice(('', digits(2)))}@{host}", ".".join(str(rng.randint(1, 255)) for _ in range(4)), phone, card)
        for kind, span in zip(("email", "ip", "phone", "card"), base):
            texts += [f"{a}{t}{b}" for _, t in rewritten(kind, span)]
        other = (
            f"{rng.choice(('look', 'meet us', 'arrived'))} at {rng.choice(('the', 'our', 'that'))} dot com", f"at {rng.choice(hosts)} dot matrix", f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} 1{digits(1)}",
            f"1{digits(1)}:2{digits(1)}:3{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)}-{digits(5)}-{digits(4)}", digits(rng.randint(9, 18)), ":".join(hexes(4) for _ in range(rng.choice((4, 5, 7)))),
            f"0{digits(3)} {digits(7)}", f"{digits(3)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(3)}-{digits(4)}", ":".join(hexes(2) for _ in range(6)), f"see you at {host}",
        )
        texts.append(f"{a}{other[i % len(other)]}{b}")
        texts.append(f"{a}{rng.choice(names)} at {rng.choice(('the', 'our', 'that', 'a', 'this'))} dot {rng.choice(tops)}{b}")
        texts += [f"{rng.choice(('see you', 'meet', 'they look', 'sold'))} at {host}{b}", f"{a}{rng.choice(names)} at {host}{b}"]
        numbers = f"0{rng.randint(10, 999)} {digits(7)}", f"00{rng.randint(30, 49)} {rng.randint(20, 99)} {digits(7)}", f"0{rng.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"6{digits(2)} {digits(3)} {digits(3)}", digits(rng.randint(7, 11)), f"{digits(3)}-{digits(4)}"
        texts.append(f"{rng.choice(('Tel. ', 'call ', 'phone: ', 'mobile ', 'appelez ', 'Telefon: ', '', 'and ', 'wir '))}{rng.choice(numbers)}{b}")
        strong, weak = rng.choice(("password", "passwd", "db_password", "token", "client_secret", "api_key", "Passwort", "contraseña")), rng.choice(("key", "auth", "Authorization: Bearer"))
        mixed, word = "".join(rng.choice("abcdefGHIJKLmnop0123456789") for _ in range(rng.randint(16, 40))), "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(4, 11)))
        value = rng.choice((word + digits(1) + "!", word + digits(2), "!$".join((word, digits(2))), mixed, f"sk_{word}.{mixed}", word + "$", hexes(40), word, word.title() + word.title(), f"{word}={digits(3)}"))
        value = value + rng.choice("bcxyz") + digits(1) if len(value) < 4 else value
        sep, quote = rng.choice((": ", "=", " = ", ":", " is ")), rng.choice(("", "", '"', "'"))
        texts += [f"{a}{strong}{sep}{quote}{value}{quote}{b}", f"{a}{weak}{sep}{value}{b}", f"{a}{weak} {mixed}{b}", f"{a}{strong} sk_{word}.{word}.{mixed}{b}"]
        texts += [f"{a}AKIA{mixed.upper()[:16]}{b}"] if i % 4 == 0 else []
        useless = (
            f"commit {hexes(40)}", f"file part-{digits(5)}-{hexes(12)}.csv", f"{strong}: {rng.choice(('required', 'none', 'null', 'please', '****', '<yours>'))}", f"{strong}: {word} and {word}", f"{weak}: {word}", f"{strong} is {word}", f"{weak} is {word}",
            f"{strong} = get{word}()", f"www.{word}{digits(2)}.{word}.org/{word}", f"{strong}: {digits(2)}{digits(1)}", f"id {mixed}", f"{weak}: {digits(5)}", f"{word}.{word}{digits(9)}", f"{strong}: https://{word}.org/{digits(3)}",
        )
        texts += [f"{a}{useless[i % len(useless)]}{b}", f"{a}{useless[(i + 5) % len(useless)]}{b}"]
    return texts


EXAMPLES = "kind string, good int, x array<double>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row for text in batch.column("text").to_pylist() for row in labelled(text or "")]
        if rows:
            kinds, good, x = zip(*rows)
            yield pa.RecordBatch.from_pydict({"kind": list(kinds), "good": pa.array(good, pa.int32()), "x": pa.array(x, pa.list_(pa.float64()))})


def _fixed_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The primers' rows and their fold."""
    for batch in batches:
        rows = [row for text in batch.column("text").to_pylist() for row in labelled(text)]
        if rows:
            kinds, good, x = zip(*rows)
            fold = [zlib.crc32(f"{row}".encode()) % 10 < 3 for row in rows]
            yield pa.RecordBatch.from_pydict({"kind": list(kinds), "good": pa.array(good, pa.int32()), "x": pa.array(x, pa.list_(pa.float64())), "fold": fold})


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind, features and row numbers of the rows of each kind."""
    kinds = np.array(batch.column("kind").to_pylist(), object)
    x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
    for kind in ADDED:
        own = np.flatnonzero(kinds == kind)
        if len(own):
            yield kind, x[own], own


def _coarse(x: np.ndarray) -> np.ndarray:
    """Values rounded up to twelve binary digits (whole numbers to 4096 stay), so that few are distinct in any table."""
    part, power = np.frexp(x)
    return np.ldexp(np.ceil(part * 4096) / 4096, power)


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each coarse value of a feature occurs; feature -1 is the label."""
    counts: dict[tuple[str, int, float], int] = {}
    for batch in batches:
        good = batch.column("good").to_numpy()
        for kind, x, own in _by_kind(batch):
            for i, column in [(-1, good[own].astype(float)), *enumerate(_coarse(x).T)]:
                for value, n in zip(*(a.tolist() for a in np.unique(column, return_counts=True))):
                    counts[kind, i, value] = counts.get((kind, i, value), 0) + n
    if counts:
        kinds, features_, values = zip(*counts)
        yield pa.RecordBatch.from_pydict({"kind": list(kinds), "feature": pa.array(features_, pa.int32()), "value": list(values), "n": pa.array(counts.values(), pa.int64())})


def fit(docs: DataFrame, *, train_docs: int | None = None, train_candidates: int | None = None, precision: float = 0.99) -> Detector:
    """Fit trees and thresholds on all distinct candidates, or where a limit is given on a hash sample of about so many texts or of so many candidates."""
    spark, texts = docs.sparkSession, docs.select("text")
    if train_docs is not None:
        distinct = docs.select(F.approx_count_distinct(F.xxhash64("text"), 0.01)).first()[0]
        share = min(1.0, train_docs / distinct) if distinct else 1.0
        texts = texts.where(F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 30)) < share * float(1 << 30))
    taken = map_texts(texts, _examples, EXAMPLES).distinct().withColumn("_h", F.xxhash64("kind", "good", "x"))
    if train_candidates is not None:
        taken = taken.orderBy("_h", "kind", "good").limit(train_candidates)
    taken = taken.select("kind", "good", "x", (F.crc32(F.col("_h").cast("string").cast("binary")) % 10 < 3).alias("fold"), F.lit(True).alias("own"))
    fixed = map_texts(spark.createDataFrame([(t,) for t in primers()], "text string"), _fixed_examples, f"{EXAMPLES}, fold boolean")
    rows = stored(taken.unionByName(fixed.withColumn("own", F.lit(False))), "candidates")
    models = _grown(rows.where("NOT fold"))
    detector = Detector(models, {})
    shared = spark.sparkContext.broadcast(models)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, x, own in _by_kind(batch):
                if kind in shared.value:
                    odds = shared.value[kind].log_odds(x)
                    part = batch.select(["kind", "own", "good"]).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.floor(odds * CELLS).astype(np.int64)), pa.array(1 / (1 + np.exp(-odds)))], ["kind", "own", "good", "cell", "p"])

    judged = rows.where("fold").mapInArrow(cells, "kind string, own boolean, good int, cell bigint, p double")
    counted = judged.groupBy("kind", "own", "cell").agg(F.sum("good").alias("good"), F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
    # thresholds come from the documents alone where these have enough positives
    enough = {k for k in ADDED if sum(r.good for r in counted if r.kind == k and r.own) >= OWN_POSITIVES}
    merged: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for r in counted:
        if r.own or r.kind not in enough:
            low, high, good, n = merged.get((r.kind, r.cell), (1.0, 0.0, 0, 0))
            merged[r.kind, r.cell] = min(low, r.low), max(high, r.high), good + r.good, n + r.n
    if merged:
        low, high, good, n = np.array(list(merged.values()), float).T
        detector.thresholds = calibrate(np.array([k for k, _ in merged]), low, good, precision, n=n, top=high)
    return detector


def _grown(rows: DataFrame) -> dict[str, Trees]:
    """The trees of each kind in stored ``rows``; the rows stay in blocks, one task's histograms are added to another's."""
    counts = rows.mapInArrow(_value_counts, "kind string, feature int, value double, n bigint").groupBy("kind", "feature", "value").agg(F.sum("n").alias("n")).collect()
    by_feature: dict[tuple[str, int], list[tuple[float, int]]] = {}
    for r in counts:
        by_feature.setdefault((r.kind, r.feature), []).append((r.value, r.n))
    models, total = {}, 0
    for kind in sorted({k for k, _ in by_feature}):
        values = [np.array(sorted(by_feature[kind, i])).T for i in range(-1, len(FEATURES))]
        models[kind] = _started([edges_of(v, n) for v, n in values[1:]], (values[0][0] * values[0][1]).sum(), values[0][1].sum())
        total += int(values[0][1].sum())
    widths = {k: [len(e) + 1 for e in m.edges] for k, m in models.items()}
    shared = rows.sparkSession.sparkContext.broadcast({k: Trees(m.edges, [], m.start) for k, m in models.items()})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(kind: str) -> pa.RecordBatch:
            b, good = (np.concatenate(a, axis=-1) for a in zip(*held.pop(kind)))
            return pa.RecordBatch.from_pydict({"kind": [kind], "bins": pa.array([b.tobytes()], pa.binary()), "good": pa.array([good.tobytes()], pa.binary())})

        for batch in batches:
            good = batch.column("good").to_numpy().astype(np.uint8)
            for kind, x, own in _by_kind(batch):
                held.setdefault(kind, []).append((shared.value[kind].binned(x), good[own]))
                if sum(len(g) for _, g in held[kind]) >= BLOCK_ROWS:
                    yield packed(kind)
        for kind in list(held):
            yield packed(kind)

    def opened(row) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        good = np.frombuffer(row.good, np.uint8)
        return row.kind, np.frombuffer(row.bins, np.uint8).reshape(len(FEATURES), len(good)), good, np.full(len(good), shared.value[row.kind].start)

    few = rows.coalesce(max(1, -(-total // BLOCK_ROWS)))
    parts = few.mapInArrow(blocks, "kind string, bins binary, good binary").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    begun = 0

    def added(one: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {k: one[k] + other[k] if k in one and k in other else one.get(k, other.get(k)) for k in {*one, *other}}

    def sums(level: int) -> dict[str, np.ndarray]:
        trees = {k: m.trees[begun:] for k, m in models.items()}

        def run(blocks: Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
            out: dict[str, np.ndarray] = {}
            for kind, b, good, odds in blocks:
                out = added(out, {kind: histograms(b, good, odds, trees[kind], widths[kind], level)})
            yield out

        return parts.mapPartitions(run).treeReduce(added)

    for done in grow(models, sums, rounds=ROUNDS):
        if done % SETTLE == 0 and done < ROUNDS:
            trees, before = {k: m.trees[begun:] for k, m in models.items()}, parts
            parts = before.map(lambda r, trees=trees: (*r[:3], settled(r[1], r[3], trees[r[0]]))).persist(StorageLevel.MEMORY_AND_DISK)
            parts.count()
            before.unpersist()
            begun = done
    parts.unpersist()
    return models


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """Per row: base counts, the sha256 of the base spans, and all spans (base kinds first, each by start)."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.spans(t or "") for t in batch.column("text").to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE}
            hashes = [hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found]
            spans = [digest(base + more) for base, more in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), **counts, "base_sha256": pa.array(hashes, pa.string()), "spans": pa.array(spans, pa.string())})

    return map_texts(docs.select("doc_id", "text"), run, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with redacted texts (NULL stays NULL) and, where the column is there, ``n_chars`` of the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column("text").to_pylist():
                base, more = shared.value.spans(t or "")
                texts.append(redacted(t, base + more) if base or more else t)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    cleaned = map_texts(docs, run, docs.schema)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
