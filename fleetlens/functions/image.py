"""Container image references: validation and repository.

One regular expression validates a whole reference and captures its
repository, so a row costs one match however many places ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import SPACE, strip

# The reference grammar and the digest lengths of registered algorithms.
DIGEST = "[a-z0-9]+(?:[+._-][a-z0-9]+)*:[A-Za-z0-9=_-]+"
DIGEST_HEX = {"sha256": 64, "sha512": 128, "blake3": 64}
TAG = "[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}"
HOST_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
MAX_HOST = 253
PORT = "0*(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"


def _ipv6_pattern() -> str:
    """IPv6 text forms: full, with one ``::`` gap, with a dotted tail, with a zone."""
    group = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?:{group}:{group}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{group}:){{6}}{tail}"]
    for after in range(5, -1, -1):
        before = 5 - after
        head = f"(?:(?:{group}:){{0,{before - 1}}}{group})?" if before else ""
        forms.append(f"{head}::(?:{group}:){{{after}}}{tail}")
    forms.append(f"(?:(?:{group}:){{0,5}}{group})?::{group}")
    forms.append(f"(?:(?:{group}:){{0,6}}{group})?::")
    return rf"(?:{'|'.join(forms)})(?:%[^%\]]+)?"


IPV6 = _ipv6_pattern()


def _path_pattern() -> str:
    """Lower-case parts; inside a part single ``.`` or ``_``, ``__`` or dashes stand between letters.

    Written as a character class and a scan for forbidden neighbours, because a
    repeated group recurses on every repetition.
    """
    forbidden = r"\.[._-]|_[.-]|-[._]|___|//|[._-]/|/[._-]"
    letters = "[a-z0-9._/-]*"
    return rf"(?!{letters}?(?:{forbidden}))[a-z0-9](?:{letters}[a-z0-9])?"


def _reference_pattern() -> str:
    """The whole reference, with the repository as group 1.

    A first part followed by a slash is a registry when it is ``localhost``, a
    bracketed address or has a dot or a colon; it must be valid then.
    """
    host = rf"(?=[^/:]{{1,{MAX_HOST}}}[/:]){HOST_LABEL}(?:\.{HOST_LABEL})*"
    dns = rf"(?:localhost(?=[/:])|(?=[^/]*[.:]){host})(?::{PORT})?"
    address = rf"\[(?:{IPV6})\](?::{PORT})?"
    bare = r"(?![^/]*\.[^/]*/)"
    path = _path_pattern()
    known = "|".join(f"{name}:[0-9a-f]{{{length}}}" for name, length in DIGEST_HEX.items())
    digest = f"(?:{known}|(?!(?:{'|'.join(DIGEST_HEX)}):){DIGEST})"
    repository = rf"(?:(?:{dns}|{address})/{path}|{bare}{path})"
    return rf"(?U)\A{SPACE}*({repository})(?::{TAG})?(?:@{digest})?{SPACE}*\z"


REFERENCE = _reference_pattern()


def image_repository(image: Column) -> Column:
    """Repository of a valid reference without tag and digest, ``""`` for a malformed one."""
    return F.regexp_extract(image, REFERENCE, 1)


def images_from_flag(flag: Column) -> Column:
    """Owned images of a comma list; NULL switches the ownership check off."""
    return F.filter(F.transform(F.split(flag, ","), strip), lambda x: x != "")
