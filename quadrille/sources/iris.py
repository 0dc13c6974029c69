"""IRI references: what may stand in one, and their resolution against a base (RFC 3986, section 5.2)."""

from __future__ import annotations

import re

_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
_BAD = re.compile(r'[\x00-\x20<>"{}|^`\\]')


def is_absolute(ref: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", ref) is not None


def check(iri: str) -> str:
    """The IRI, if no character is in it that can't be."""
    if (m := _BAD.search(iri)) is not None:
        raise ValueError(f"{m[0]!r} in the IRI {iri!r}")
    return iri


def _merged(path: str) -> str:
    """The path without dot segments."""
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "." or s == "..":
            if s == ".." and len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out)


def resolve(base: str, ref: str) -> str:
    scheme, authority, path, query, fragment = _PARTS.fullmatch(ref).groups()
    if scheme is not None:
        return ref if "/." not in path else _joined(scheme, authority, _merged(path), query, fragment)
    if not base:
        return ref
    b_scheme, b_authority, b_path, b_query, _ = _PARTS.fullmatch(base).groups()
    if authority is None:
        authority = b_authority
        if not path:
            path, query = b_path, b_query if query is None else query
        elif path.startswith("/"):
            path = _merged(path)
        else:
            stem = "/" if b_authority is not None and not b_path else b_path[: b_path.rfind("/") + 1]
            path = _merged(stem + path)
    else:
        path = _merged(path)
    return _joined(b_scheme, authority, path, query, fragment)


def _joined(scheme: str | None, authority: str | None, path: str, query: str | None, fragment: str | None) -> str:
    out = "" if scheme is None else scheme + ":"
    out += "" if authority is None else "//" + authority
    out += path
    out += "" if query is None else "?" + query
    return out + ("" if fragment is None else "#" + fragment)
