"""Credentials embedded in source code and configuration.

Quoted strings, assigned values and long tokens are taken out of a text
together with the name that they are given. The Shannon entropy of each, in the
alphabet that it uses, is compared with a threshold that depends on its length
and on what its surroundings say: a value that is named a password needs
little, a token without a name must look random. Hashes, identifiers,
references and known placeholders are left out.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import spread

MARK = "[REDACTED]"

#: Words of names that announce a credential, alone or before
#: "key"; last words that say the value is about one, not one; and words that
#: make a name one of a hash or of something public.
SECRET_WORDS = set("password passwd pwd pass passphrase passcode secret secrets token apikey credential credentials auth authorization sig signature pat jwt bearer authtoken accesstoken".split())
KEY_OWNERS = set("api access private signing secret encryption encrypt auth account master service session deploy shared client hmac ssh webhook storage license licence app application consumer".split())
ABOUT_WORDS = set("name names header headers length len min max minimum maximum limit limits budget budgets count counts ttl timeout path paths file files dir folder url uri endpoint host port type types policy prompt label field fields hint enabled required rotation expiry expires expiration age version format prefix suffix space size usage ref reference arn store provider kind class scheme hash hashes algorithm alg digest checksum bits days hours minutes seconds rate window bucket queue topic index column table user username email env var variable mode style count regex pattern template rules strength attempts retries".split())
PUBLIC_WORDS = set("public pub hash sha sha1 sha256 sha512 md5 checksum digest etag fingerprint integrity uuid guid".split())

#: Pairs of letters that hardly any English word has, without
#: those that common abbreviations have.
UNHEARD_PAIRS = set("""bk bq bx cb cf cg cj cp cv cw cx dx fk fq fv fz gq gv gx hk hv hx hz iy jc jf jg jh jj jk jl jm jn jr jt jx jy jz kq kx kz lq lx mg mj mx mz
    pq pv qb qc qd qf qg qh qj qk ql qm qn qq qv qw qx qy qz tq vd vf vh vj vk vn vq vt vw vz wq wv wz xb xg xj xk xq xz yq yv zb zc zg zh zj zq zr zs zx""".split())

#: Consonants of words for credentials, which misspelt names keep.
_SKELETONS = set("psswrd psswd scrt crdntl crdntls pssphrs".split())

#: Placeholders, whole or as parts.
_PLACEHOLDER = re.compile(
    r"""^(?:none|null|nil|undefined|true|false|yes|no|on|off|n/?a|tbd|todo|fixme|empty|unset|missing|redacted|hidden|masked|string|str|bool|int|bytes|text|any|object|unknown|void|self|value|values?|default|optional|required|
    pass|pwd|example|sample|dummy|test|testing|fake|mock|foo|bar|baz|foobar|password|passwd|secret|token|key|apikey|api[-_]?key|username|user|admin|root|guest|changeit|change[-_ ]?me|replace[-_ ]?me|insert.*|enter.*|fill.*|your.*|my[-_]?(?:password|secret|token|key|api[-_]?key).*|put.*here.*|.*[-_ ]here|
    x{3,}.*|\*+|\.{2,}|…+|-+|_+|\#+|•+|<.*>|\[.*\]|\{\{.*\}\}|\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|%\(?\w*\)?[sd]|\{[^"]*\}|@\w+@|\#\{.*\}|(.)\1{4,})$""",
    re.I | re.X,
)
_MASKED = re.compile(r"\*{3,}|x{5,}|\.{3}|<[^<>\n]{1,40}>|\$\{[^}\n]*\}|\{\{|your[-_]|change[-_]?me|placeholder|redacted|example", re.I)
_REFERENCE = re.compile(
    r"^(?:vault:|env:|secret:|secrets?/|ssm:|kms:|arn:|op://|file:|kv/|gcp:|aws:|azure:|ref:|keyring:|keychain:|!(?:Ref|Sub|GetAtt|vault|secret)\b|\./|\.\./|~/|/[A-Za-z]|[A-Za-z]:\\|projects/|process\.env|os\.(?:environ|getenv)|System\.getenv|std::env|env\.|config\.|settings\.|self\.|this\.|state\.|req\.|args\.|options\.|https?://[^:@\s]*$)",
    re.I,
)
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
_WORDLIKE = re.compile(r"^[A-Za-z]+(?:[-_ .:/@][A-Za-z]+)*$")
_IDENTIFIER = re.compile(r"^(?:[A-Za-z]{2,}\d{0,3}|\d{1,4})(?:[-_./:](?:[A-Za-z]{2,}\d{0,3}|\d{1,4}|[A-Za-z]))*$")
_WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")

_NAME = r"[A-Za-z_][\w.-]*"
_QUOTED = r"""(?:"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`)"""
_PLAIN = r"""(?P<plain>[^\s"'`,;<>(){}\[\]|][^\s"'`,;<>|]*)"""
_ASSIGNED = re.compile(
    rf"""(?P<name>(?<![\w.-]){_NAME})["']?[ \t]*\]?[ \t]*(?::[ \t]*&?[\w<>\[\]|.' ]{{1,40}}?[ \t]*=(?!=)|:=|=>|=(?![=>])|:(?![:/=]))[ \t]*(?:[rbufRBUF]{{1,2}}(?=["'])|&)?(?:{_QUOTED}|{_PLAIN})"""
)
_PAIRED = re.compile(rf"""["'](?P<name>{_NAME})["'][ \t]*,[ \t]*{_QUOTED}""")
_SETTER = re.compile(rf"""\b(?:set|with|add|put)_?(?P<name>[A-Z]\w*|_\w+)\([ \t]*{_QUOTED}""")
_ATTRIBUTES = re.compile(rf"""\b(?:key|name)=["'](?P<name>{_NAME})["'][ \t]+value={_QUOTED}""", re.I)
_SCHEME = re.compile(r"""\b(?P<name>Bearer|Basic|Token|Digest)[ \t]+(?P<plain>[^\s"'`,;<>(){}\[\]]+)""")
_USERINFO = re.compile(r"""\b[a-z][a-z0-9+.-]*://[^\s:/@"'`<>]*:(?P<plain>[^\s/"'`<>@]+(?:@(?=[^\s/"'`<>]*@)[^\s/"'`<>@]+)*)@""", re.I)
_PARAMETER = re.compile(rf"""[?&](?P<name>{_NAME})=(?P<plain>[^\s&#"'`<>]+)""")
_NETRC = re.compile(r"""\blogin[ \t]+\S+[ \t]+(?P<name>password)[ \t]+(?P<plain>[^\s"'`]+)""")
_OPTION = re.compile(rf"""(?<![\w-])--?(?P<name>{_NAME}?)(?:=|[ \t]+){_QUOTED[:-1]}|(?P<plain>(?:(?<==)-)?[^\s"'`,;<>(){{}}\[\]|-][^\s"'`<>|]*))""")
_USER_OPTION = re.compile(r"""(?<![\w-])(?:-u|--user)[ \t]+["']?[\w.-]+:(?P<plain>[^\s"'`<>]+)""")
_DOCKER = re.compile(rf"""^[ \t]*ENV[ \t]+(?P<name>{_NAME})[ \t]+(?:{_QUOTED}|{_PLAIN})""", re.M)
_BELOW = re.compile(rf"""(?:(?<![\w.-])(?P<name>{_NAME})["']?[ \t]*:[ \t]*\r?\n|\bname:[ \t]*["']?(?P<name2>{_NAME})["']?[ \t]*\r?\n)[ \t]*value:[ \t]*(?:{_QUOTED}|{_PLAIN})""")
_PARTS = re.compile(rf"""(?<![\w.-])(?P<name>{_NAME})["']?\]?[ \t]*(?::[ \t]*[\w &]+)?(?::=|=|:)[ \t]*\(?[ \t]*(?:\\)?\r?\n(?P<parts>(?:[ \t]*(?:"[^"\n]*"|'[^'\n]*')[ \t]*[+\\.]?[ \t]*\r?\n?){{1,40}})""")
_SAME_LINE_PARTS = re.compile(rf"""(?<![\w.-])(?P<name>{_NAME})["']?\]?[ \t]*(?::=|=|:)[ \t]*(?P<parts>(?:"[^"\n]*"|'[^'\n]*')(?:[ \t]*\+[ \t]*(?:"[^"\n]*"|'[^'\n]*'))+)""")
_PART = re.compile(r"""["']([^"'\n]*)["']""")
_BLOCK = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]+)-----(?P<body>.*?)(?:-----END (?P=what)-----|(?=-----BEGIN)|\Z)", re.S)
_BODY_LINE = re.compile(r"^[ \t>#*/|\"'+]*[A-Za-z0-9+/=]{1,120}[\"'+,;\\]*[ \t]*\r?$|^[ \t]*(?:Proc-Type|DEK-Info|Version|Comment):.*$|^[ \t\r]*$")
_DATA_URI = re.compile(r"data:[\w.+-]+/[\w.+-]+(?:;[\w=.-]+)*;base64,[A-Za-z0-9+/=\s]*?(?=[^A-Za-z0-9+/=\s]|\Z)|data:[\w.+-]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+")
_DIGEST = re.compile(r"\b(?:sha(?:1|224|256|384|512)|md5|blake2b?)[-:=][A-Za-z0-9+/=_-]{16,}|\bssh-(?:rsa|ed25519|dss)[ \t]+[A-Za-z0-9+/=]{20,}", re.I)
_TOKEN = re.compile(r"(?<![\w+/=.%-])[A-Za-z0-9_][A-Za-z0-9_+/.=-]{15,}[A-Za-z0-9_=](?![\w+/=.-])")
_ISSUED = re.compile(r"^[A-Za-z]{2,8}(?:[_-][a-z]{2,8}){0,2}[_.-][A-Za-z0-9]{14,}$")
_SITE = re.compile(r"""[=:>][ \t]*(?:[rbufRBUF]{1,2}|&)?(?="(?P<dq>(?:[^"\\\n]|\\.){8,})"|'(?P<sq>(?:[^'\\\n]|\\.){8,})'|`(?P<bq>[^`\n]{16,})`)""")
_HINT_PARTS = tuple(w.encode() for w in "pass pwd secret token key cred auth jwt bearer basic signature xap xacce".split())
_HINT_SKELETONS = re.compile("|".join("[aeiou]*".join(x) for x in sorted(_SKELETONS)).encode())
_HINT_SHORT = re.compile("|".join(rf"(?<![A-Za-z]){w}(?![a-z])|{w.title()}(?![a-z])|(?<![A-Z]){w.upper()}(?![a-z])" for w in ("sig", "pat")))
_BROKEN_UP = re.compile(r"""[=:(][ \t]*\\?\r?\n[ \t]*["']|["'][ \t]*\+[ \t]*["']""")
_JWT = re.compile(r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$")
_ACCESS_ID = re.compile(r"^[A-Z]{4}[A-Z0-9]{12,20}$")


def entropy(text: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def alphabet_size(text: str) -> int:
    """How many characters the smallest usual alphabet of a text has."""
    if _HEX.match(text):
        return 16
    if re.fullmatch(r"[A-Z2-7=]+", text):
        return 32
    if re.fullmatch(r"[A-Z0-9]+|[a-z0-9]+", text):
        return 36
    if re.fullmatch(r"[A-Za-z0-9]+", text):
        return 62
    return 64 if re.fullmatch(r"[A-Za-z0-9+/=_.-]+", text) else 94


def randomness(text: str) -> float:
    """Entropy as a share of what so long a text of its alphabet can have."""
    return entropy(text) / math.log2(max(2, min(len(text), alphabet_size(text))))


def name_says(name: str | None) -> str:
    """What a name says of its value: that it is "secret", "public" (or a
    hash), or nothing: "other"."""
    words = [w.lower() for w in _WORDS.findall(name or "")]
    if not words:
        return "other"
    if PUBLIC_WORDS & set(words) - {"digest"} and not set(words) & {"password", "passwd", "token"} or words[-1] == "digest" or "keyspace" in "".join(words):
        return "public"
    if words[-1] in ABOUT_WORDS:
        return "other"
    if set(words) & SECRET_WORDS or {re.sub(r"[aeiou]", "", w) for w in words if len(w) > 3} & _SKELETONS:
        return "secret"
    if words[-1] in ("key", "keys") and len(words) > 1 and set(words) & KEY_OWNERS:
        return "secret"
    return "secret" if "".join(words).endswith(("password", "passwd", "secret", "apikey", "token", "passphrase")) else "other"


def is_stand_in(value: str) -> bool:
    """Whether a value is to be filled in, masked or refers to something."""
    v = value.strip()
    refers = bool(_REFERENCE.match(v)) and not (v[:1] == "/" and any(looks_random(x) for x in v.split("/")))
    return not v or bool(_PLACEHOLDER.match(v)) or refers or bool(_MASKED.search(v) and len(v) < 60 and not re.search(r"[A-Za-z0-9+/]{24}", v))


def looks_random(value: str) -> bool:
    """Whether a token without a telling name must be a credential."""
    if len(value) < 16 or _UUID.match(value) or _HEX.match(value):
        return False
    if _JWT.match(value):
        return True
    digits = sum(c.isdigit() for c in value)
    if _ACCESS_ID.match(value):
        return (digits >= 2 or _jumbled(value)) and randomness(value) >= 0.7
    if _ISSUED.match(value):
        tail = re.split(r"[_.-]", value)[-1]
        return len(tail) >= 14 and not _HEX.match(tail) and (digits >= 1 or len(tail) >= 20 and _jumbled(tail)) and randomness(tail) >= 0.78 and bool(re.search(r"[a-z]", tail) and re.search(r"[A-Z]", tail) or digits >= 3)
    if _IDENTIFIER.match(value) or "/" in value and all(_WORDLIKE.match(p) or not p for p in re.split(r"[/.]", value)):
        return False
    core = value.rstrip("=")
    upper, lower = any(c.isupper() for c in core), any(c.islower() for c in core)
    if len(core) < 20 or not digits or not (upper and lower):
        return False
    longest = max(len(w) for w in re.findall(r"[a-z]+|[A-Z]+|\d+|.", core))
    return longest <= 8 and randomness(core) >= 0.82 and digits / len(core) >= 0.04


def is_credential(value: str, says: str, quoted: bool) -> bool:
    """Whether a value given to such a name is a live-looking credential."""
    if is_stand_in(value):
        return False
    v = value.strip()
    if says != "secret":
        return says == "other" and looks_random(v)
    if _UUID.match(v) or len(v) < 6 or re.search(r"\s", v) and not quoted:
        return False
    if v.startswith(("http://", "https://")) or re.match(r"^[\w.]+\(", v) or re.fullmatch(r"[\d.,:_-]+", v) and len(v) < 8:
        return False
    if _WORDLIKE.match(v):
        return _jumbled(v)
    if not quoted and re.match(r"^[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+$", v) and not _JWT.match(v) and not re.search(r"\d", v):
        return False
    return randomness(v) >= 0.55


def _jumbled(value: str) -> bool:
    """Whether letters alone look drawn at random: cases that change without
    forming words, or hardly any vowels."""
    letters = re.sub(r"[^A-Za-z]", "", value)
    n, parts = len(letters), len(_WORDS.findall(value))
    if n < 8 or randomness(value) < 0.7:
        return False
    runs = re.search(r"[a-z][A-Z]{2}|[A-Z]{3}[a-z]", letters) and re.search(r"[a-z]", letters)
    few = len(re.findall(r"[aeiouAEIOU]", letters)) < 0.26 * n
    words = _WORDS.findall(value)
    if any(a + b in UNHEARD_PAIRS for w in words for a, b in zip(w.lower(), w.lower()[1:])) and (runs or n >= 10):
        return True
    mute = any(len(w) > 1 and w[1:].islower() and not re.search(r"[aeiouy]", w.lower()) for w in words)
    return n < 2.7 * parts or bool(runs) and (n < 3.4 * parts or mute) or few and n >= 10


def _may_tell(text: str) -> bool:
    """Whether a name in a text may count as secret for name_says, or a value
    with a scheme may occur: never False where one does. Signs that name_says
    ignores inside names are left out first."""
    plain = text.encode("ascii", "ignore").lower().translate(None, b"_.-")
    return any(w in plain for w in _HINT_PARTS) or bool(_HINT_SHORT.search(text) or _HINT_SKELETONS.search(plain))


def _may_assign(text: str) -> bool:
    """Whether assignments and options in a text may hold a credential: by a
    name, or by a quoted value that looks random without one."""
    return _may_tell(text) or any(looks_random((m["dq"] or m["sq"] or m["bq"]).strip()) for m in _SITE.finditer(text))


def find_credentials(text: str, name: str | None = None) -> list[tuple[list[tuple[int, int]], str]]:
    """Credentials in a text: the spans of each value, and how it was found.

    name: what the whole text is the value of, as for an environment variable.
    Spans don't overlap; a value written in parts has several.
    """
    found: list[tuple[list[tuple[int, int]], str]] = []
    taken = bytearray(len(text))

    def free(a: int, b: int) -> bool:
        return a < b and not any(taken[a:b])

    def take(spans: list[tuple[int, int]], how: str | None) -> None:
        for a, b in spans:
            taken[a:b] = b"\1" * (b - a)
        if how:
            found.append((spans, how))

    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            a, b = m.span("body")
            if "-----END" not in text[b : b + 8]:
                kept = a
                first = True
                for line in text[a:b].split("\n"):
                    if not first and not _BODY_LINE.match(line):
                        break
                    kept += len(line) + 1
                    first = False
                b = min(kept, b)
            private = "PRIVATE KEY" in m.group("what")
            body = re.sub(r"\\[nr]|\s", "", text[a:b])
            real = private and len(re.findall(r"[A-Za-z0-9+/]", body)) >= 32 and not _MASKED.search(body)
            if real:
                start = m.start()
                take([(a, b)], None)
                found.append(([(a, b)], f"key block@{start}"))
            else:
                take([(m.start(), b)], None)
    for pattern in (_DATA_URI, _DIGEST):
        for m in pattern.finditer(text):
            take([m.span()], None)

    def group(m) -> tuple[str, int, int, bool]:
        for g in ("dq", "sq", "bq", "plain"):
            if g in m.re.groupindex and m.group(g) is not None:
                return m.group(g), *m.span(g), g != "plain"
        return "", 0, 0, False

    def consider(value: str, a: int, b: int, says: str, quoted: bool, how: str) -> None:
        scheme = re.match(r"(?:Bearer|Basic|Token)[ \t]+", value)
        if scheme:
            value, a = value[scheme.end() :], a + scheme.end()
            if value.strip() and says != "public" and free(a, b) and not is_stand_in(value) and (len(value) >= 6):
                if re.search(r"\d|[A-Z].*[a-z].*[^A-Za-z]|[A-Za-z0-9+/]{20}", value) or _is_basic(value):
                    take([(a, b)], "scheme")
            return
        if is_stand_in(value):
            return
        if not quoted:
            trimmed = value.rstrip(".,:)]}")
            if value.endswith(("==", "=")):
                trimmed = value
            b -= len(value) - len(trimmed)
            value = trimmed
        if free(a, b) and "://" not in value and not value.lstrip().startswith(("{", "[")) and is_credential(value, says, quoted):
            take([(a, b)], how)

    low = text.lower()
    tokens = [m.span() for m in _TOKEN.finditer(text) if not is_stand_in(m.group()) and looks_random(m.group()) and not _path_around(text, *m.span())]
    for m in _USERINFO.finditer(text) if "://" in text and "@" in text else ():
        value, a, b, _ = group(m)
        if free(a, b) and not is_stand_in(value) and len(value) >= 4 and (_jumbled(value) or not _WORDLIKE.match(value)):
            take([(a, b)], "address")
    for m in _USER_OPTION.finditer(text) if "-u" in text else ():
        value, a, b, _ = group(m)
        if free(a, b) and is_credential(value, "secret", False):
            take([(a, b)], "command")
    for pattern in (_PARTS, _SAME_LINE_PARTS) if _BROKEN_UP.search(text) else ():
        for m in pattern.finditer(text):
            spans = [p.span(1) for p in _PART.finditer(text, *m.span("parts"))]
            value = "".join(text[a:b] for a, b in spans)
            says = name_says(m.group("name"))
            if spans and all(free(a, b) for a, b in spans) and is_credential(value, says, True) and (says == "secret" or len(spans) > 1):
                take(spans, "parts")
    for pattern, how in ((_BELOW, "document"), (_ATTRIBUTES, "document"), (_PAIRED, "argument"), (_SETTER, "argument"), (_NETRC, "command"), (_PARAMETER, "address")):
        if pattern is _BELOW and "value:" not in text or pattern is _ATTRIBUTES and "value=" not in low or pattern is _NETRC and "login" not in text or pattern is _PARAMETER and "=" not in text:
            continue
        for m in pattern.finditer(text):
            value, a, b, quoted = group(m)
            given = m.group("name") or (m.groupdict().get("name2") or "")
            says = name_says(given)
            if pattern is _PAIRED and re.search(r"auth|api|key|token", given, re.I) and re.match(r"X-|Authorization", given, re.I):
                says = "secret"
            consider(value, a, b, says, quoted or pattern in (_PARAMETER, _NETRC), how)
    for m in _SCHEME.finditer(text) if any(w in text for w in ("Bearer", "Basic", "Token", "Digest")) else ():
        value, a, b, _ = group(m)
        value = value.rstrip("\\.,")
        b = a + len(value)
        if m.group("name") == "Basic":
            good = _is_basic(value)
        elif m.group("name") == "Bearer":
            good = len(value) >= 8 and bool(re.search(r"\d", value) or randomness(value) > 0.7 and re.search(r"[a-z].*[A-Z]|[^\w.-]", value))
        else:
            good = looks_random(value)
        if free(a, b) and good and not is_stand_in(value):
            take([(a, b)], "scheme")
    # Public values matter only where something could be found without them.
    for pattern in (_OPTION, _DOCKER, _ASSIGNED) if tokens or name is not None or _may_assign(text) else ():
        at = 0
        while True:
            m = pattern.search(text, at)
            if not m:
                break
            value, a, b, quoted = group(m)
            says = name_says(m.group("name"))
            if re.match(r"X-(?:Auth|Api|Access)", m.group("name") or "", re.I) and says != "public":
                says = "secret"
            before = len(found)
            if says != "other" or quoted:
                if says == "secret" or pattern is _ASSIGNED:
                    consider(value, a, b, says, quoted, "value")
            if says == "public" and quoted and free(a, b):
                take([(a, b)], None)
            elif says == "public" and free(a, b) and value:
                take([(a, b)], None)
            at = m.end() if len(found) > before else max(m.start() + 1, m.end("name") if m.group("name") else m.start() + 1)
    if name is not None:
        says = name_says(name)
        whole = re.sub(r"[ \t]+#.*$", "", text) if "\n" not in text else text
        m = re.match(r"""\s*(?:"([^"]*)"|'([^']*)'|(.*?))\s*$""", whole, re.S)
        if m:
            g = next(k for k in (1, 2, 3) if m.group(k) is not None)
            value, (a, b) = m.group(g), m.span(g)
            consider(value, a, b, says, True, "value")
            if says == "public":
                take([(0, len(text))], None)
    for a, b in tokens:
        if free(a, b):
            take([(a, b)], "token")
    return found


def _is_basic(value: str) -> bool:
    """Whether base64 text holds a user and a password."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, secret = plain.partition(":")
    return bool(colon and secret) and not is_stand_in(secret)


def _path_around(text: str, a: int, b: int) -> bool:
    """Whether a token is a part of a path or an address without secrets."""
    return text[max(0, a - 3) : a].endswith(("//", "/", "@")) or text[b : b + 1] in ("(", "/")


def credential_line(text: str, spans: list[tuple[int, int]], how: str) -> int:
    """The line, from 1 and split at LF, on which a credential begins."""
    at = int(how.split("@")[1]) if "@" in how else spans[0][0]
    return text.count("\n", 0, at) + 1


def redact(text: str, found: list[tuple[list[tuple[int, int]], str]]) -> str:
    """The text with each value replaced by MARK, a value in parts at its first
    part; everything around stays as it is."""
    edits = sorted(((a, b, MARK if k == 0 else "") for spans, _ in found for k, (a, b) in enumerate(spans)), reverse=True)
    for a, b, mark in edits:
        text = text[:a] + mark + text[b:]
    return text


def _values(df: DataFrame, src: str, id_col: str, text_col: str, name_col: str | None) -> DataFrame:
    name = F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")
    kept = df.select(F.lit(src).alias("src"), F.col(id_col).cast("bigint").alias("row_id"), name.alias("name"), F.lit(bool(name_col)).alias("named"), F.col(text_col).cast("string").alias("text"))
    return kept.where(F.col("text").isNotNull() & (F.length("text") > 0))


def credentials(df: DataFrame, src: str, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """One row per credential: ``src``, ``row_id``, ``line_no``,
    ``start_offset``, ``how``, ``n_chars`` of its value and its ``entropy``.
    Repeats are dropped from the result, so that texts needn't be shuffled.

    name_col names the variable whose value the whole text is. Null and empty
    texts hold none; a null name says nothing. Repeated rows count once, other
    columns are ignored, an empty table gives an empty result, texts of any
    length are searched whole.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for spans, how in find_credentials(r.text, (r.name or "") if r.named else None):
                    value = "".join(r.text[a:b] for a, b in spans)
                    rows.append([r.src, r.row_id, 1 if r.named else credential_line(r.text, spans, how), spans[0][0], how.split("@")[0], len(value), entropy(value)])
            yield pd.DataFrame(rows, columns=["src", "row_id", "line_no", "start_offset", "how", "n_chars", "entropy"])

    return spread(_values(df, src, id_col, text_col, name_col)).mapInPandas(search, "src string, row_id bigint, line_no int, start_offset int, how string, n_chars int, entropy double").distinct()


def redacted(df: DataFrame, src: str, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """One row per distinct text that holds credentials: ``src``, ``row_id``,
    ``n_credentials`` and ``redacted``, the text without them."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                found = find_credentials(r.text, (r.name or "") if r.named else None)
                if found:
                    rows.append([r.src, r.row_id, len(found), redact(r.text, found)])
            yield pd.DataFrame(rows, columns=["src", "row_id", "n_credentials", "redacted"])

    return spread(_values(df, src, id_col, text_col, name_col)).mapInPandas(clean, "src string, row_id bigint, n_credentials int, redacted string").distinct()
