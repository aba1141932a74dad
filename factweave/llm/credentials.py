"""Credentials embedded in source code and configuration (problem 2).

Every line yields *candidates*: literals with the identifier they belong to. A logistic regression
scores them. Its features are the likelihood of the value under two character Markov chains (values
with the shape of a secret, and all other literals; both counted over the whole corpus), the words of
the identifier and of the call around it, the shape of the value, and the kind of file. It is trained
on weak labels: literals that match a pattern of known secrets or a name that says so, against
placeholders, references and values whose name says what else they are. Scores are calibrated on a
held-out part, and what lies above the threshold is redacted; all other text stays as it is.

``detect`` reads the texts once: the candidates are kept by the executors while the classifier is fitted
and they are scored, and released then. Values never go to a checkpoint or any other shared file.
"""

from __future__ import annotations

import base64
import binascii
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.tables import cut_lineage, spread

#: Bound of the weakly labelled sample the classifier is fitted on.
MAX_TRAINING_ROWS = 20_000
#: Share of the sample kept for calibration.
HELD_OUT = 0.25
#: Least calibrated probability of a credential.
THRESHOLD = 0.5
REDACTED = "[REDACTED]"

#: Words of a name that speak for a secret, and words that say it is something else.
SECRET_WORDS = frozenset("password passwd pass passphrase pwd pw secret token auth authorization bearer basic key apikey credential credentials creds cred login signing private license webhook session cookie salt pin pem otp seed phrase unlock passcode passwort kennwort geheimnis schlüssel contraseña contrasena clave secreto passe motdepasse jeton 口令 密码 密碼 密钥 密鑰 令牌".split())
STRONG_WORDS = frozenset("password passwd passphrase pwd secret apikey credential credentials creds bearer authorization passwort kennwort contraseña contrasena passphrase 口令 密码 密碼 密钥 密鑰 令牌".split())
OTHER_WORDS = frozenset("digest etag integrity sha sha1 sha256 sha384 sha512 checksum commit blob trace request span correlation revision rev hash fingerprint url uri host file path dir name id ids uuid icon image max min limit count length size header content type mode kind state err error message msg page next prev cursor tokenizer public cert certificate version tag ref user username uid email region bucket env policy ttl expires expiry algorithm alg format note label title".split())
PHRASE_WORDS = frozenset("password passwd passphrase phrase pwd seed mnemonic secret passwort kennwort contraseña 口令 密码 密碼".split())
#: Provider prefixes of keys and tokens.
PREFIXED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|glpat-[\w-]{12,}|npm_[A-Za-z0-9]{16,}|xox[abprs]-[\w-]{10,}|sk-[A-Za-z0-9_-]{16,}|AIza[\w-]{20,}|SG\.[\w.-]{16,}|[a-z0-9]{2,5}_(?:sk|pk|live|test|key)_(?:live_|test_)?[A-Za-z0-9]{12,}|(?:sk|rk)_(?:live|test)_\w{10,}|[A-Za-z0-9]{2,5}[._-](?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{20,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.?[\w-]*")
_PLACEHOLDER = re.compile(
    r"""^(?:[*•·.xX#_?-]{3,}|[~.*?-]{1,2}|<[^<>]*>|\$\{?[\w.:-]+\}?|\{\{.*\}\}|%\(\w+\)[sd]|%[sdvqxw]|%\w+%|\[[\w\s-]*\]|__\w+__|\{\w*\}
    |(?:your|my|the|insert|enter|put|add)[_\s-].*|.*[_-]here|.*(?:change[_-]?me|replace[_-]?(?:me|this)|redacted|masked|placeholder|example[_-]?(?:key|token|secret|password)|not[_-]?set|xxxx|\*\*\*\*|••••).*
    |(?:.*[^a-z0-9])?(?:dummy|todo|tbd|fixme|removed|hidden|omitted)(?:[^a-z0-9].*)?
    |none|null|nil|true|false|undefined|empty|unset|string|str|int|bool|bytes|secret|password|passwd|token|key|value|optional|required|test|foo|bar|n/?a|yes|no|on|off|enabled|disabled|default|auto|next|prev|vault|env)$""",
    re.I | re.X,
)
_DOTTED = re.compile(r"^[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*|\[[^\]]*\]|\(\w*\))*$")
_PATH = re.compile(r"^(?:\.{0,2}/|[a-z]:\\|~/|file:)[\w./\\${}-]*$|^[\w./-]+\.(?:pem|key|json|ya?ml|txt|env|crt|cfg|toml|py|go|js|ts)$", re.I)
_URL = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)
_WORDS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+|口令|密[码碼钥鑰]|令牌|[一-鿿]+?(?=口令|密[码碼钥鑰]|令牌)|[一-鿿]+")
_ENDING = re.compile(r"(\w{2,})(password|passwd|passphrase|pass|token|secret|key|pwd|code)$")
_HEXADECIMAL = re.compile(r"^[0-9a-fA-F]{16,}$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_BASE64 = re.compile(r"^[A-Za-z0-9+/_-]{12,}={0,2}$")


class Candidate(NamedTuple):
    """A literal: its place in the line, the name it belongs to, and how it is held."""

    start: int
    end: int
    value: str
    name: str
    how: str


_Q = r"""\\*["'`]"""
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@(?=[\w\[$])|[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s@\"'`<>]+)@(?=[\w\[$])")
_QUERY = re.compile(r"[?&;](?:amp;)?([\w.-]+)=([^&\s\"'`<>\;]+)")
_CONNECTION = re.compile(r"(?:^|[;\"'`\s])(pwd|password|passwd|pass|secret|accountkey|sharedaccesskey|token|accesskey)\s*=\s*([^;\"'`\s]{2,})(?=;)", re.I)
_SCHEME = re.compile(r"\b(Bearer|Basic|Token|ApiKey|Digest)\s+([A-Za-z0-9+/=._~!@#$%^&*?|:-]{4,}|<[^>]*>|\$\{?\w+\}?)")
_FLAG = re.compile(r"(?:^|[\s\[,(\"'`])--?([A-Za-z][\w-]*)(?:=|\s+)(?:" + _Q + r")?([^\s\"'`\],)\\]{3,})")
_IDENTIFIED = re.compile(r"\b(IDENTIFIED(?:\s+WITH\s+\w+)?\s+BY|(?:WITH\s+)?(?:ENCRYPTED\s+)?PASSWORD)\s+" + _Q + r"([^\"'`\\]{3,})" + _Q, re.I)
_ELEMENT = re.compile(r"<([\w:.-]+)(?:\s[^<>]*)?>([^<>\s]{3,})</\1>")
_ATTRIBUTES = re.compile(r"<\w[^<>]*?\b(?:key|name|id)=" + _Q + r"([^\"'`\\]+)" + _Q + r"[^<>]*?\bvalue=" + _Q + r"([^\"'`]*?)" + _Q, re.I)
_STRING = re.compile(r"(\\*)([\"'`])((?:(?!\1\2)[^\n])*?)\1\2")
_BARE = re.compile(r"^\s*(?:[-*]\s+|export\s+|set\s+|(?:ENV|ARG)\s+|\#\s*|//\s*|;\s*|--\s*|/?\*+\s*)*[\"']?([^\W\d][\w.-]*)[\"']?\s*([:=]|(?=\s))\s*([^\s\"'`,;(){}\[\]<>|=][^\s\"'`;]*?)\\*[\"']?[,;]?\s*(?:[}\]]+|\s#.*)?\s*$")
_USER_OPTION = re.compile(r"(?:^|\s)(?:-u|--user)[\s=]+" + "(?:" + _Q + r")?([\w.@-]+):([^\s\"'`\\]{3,})")
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(\S{3,})")
_PAIR = re.compile(r"\b(?:log(?:ged)?[ -]?in|sign(?:ed)?[ -]?in|connect|authenticate|use|user|account)\b[^/\n]*?[\s:](?:as|with|is)?\s*([\w.@-]+)\s+/\s+(\S{4,})\s*$", re.I)
_OPEN_LINE = re.compile(r"([^\W\d][\w$.-]*)\s*(?::\s*[\w\[\].]+\s*=|:=|=|:)\s*(?:\w+)?\(\s*$|([^\W\d][\w$.-]*)\s*(?::=|=)\s*\\?\s*$")
_STATED = re.compile(r"\b((?:[A-Za-z_]+[ _-]){0,3}[A-Za-z_]+)\s+(?:is|was|were|used to be|became|set to|equals)\s+(?:" + _Q + r")?([^\s\"'`,]{5,})(?:" + _Q + r")?", re.I)
_SCHEME_WORDS = ("Bearer", "Basic", "Token", "ApiKey", "Digest")
_VERBS = (" is ", " was ", " were ", " used to be ", " became ", " set to ", " equals ")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}", re.I)
_ABBREVIATION = re.compile(r"^(?:smtps?|https?|html|mqtt|rtsp|ldaps?|grpc|sftp|ftps|dns|tls|ssl|ssh|jwt|sdk)|ngth", re.I)
_LONG = re.compile(r"[A-Za-z0-9_.-]{14}")
#: A line without any of this holds no literal: quotes, assignments, markup, options, long tokens.
_MAYBE = re.compile(r"[\"'`=:<]|--|\s-u\s| / |[A-Za-z0-9_.-]{14}|Bearer|Basic|Token|ApiKey|Digest|login\s|(?:ENV|ARG)\s| (?:is|was|were|used to be|became|set to|equals) ", re.I)
_MARKS = frozenset("\"'`=:<")
_NUMBERED = re.compile(r"^\s{0,6}\d+\| ?")
_QUOTE_MARK = re.compile(r"^\s{0,3}> ?")
_WRAPPED = re.compile(r'^\s*"((?:[^"\\]|\\.)*)",?\s*$')
_VALUE_OPEN = re.compile(r'"[\w-]+"\s*:\s*"(?=[^"]*\\[nrt])')
_ESCAPED_BREAK = re.compile(r"\\[nrt]")


def segments(line: str) -> Iterator[tuple[int, str]]:
    """The statements of a line with their places: without line numbers and quotation marks of a
    citation, and with a text written in one JSON string taken apart at its escaped line breaks."""
    start = 0
    if ">" in line[:6] or "|" in line[:14]:
        for pattern in (_QUOTE_MARK, _NUMBERED, _QUOTE_MARK):
            if m := pattern.match(line[start:]):
                start += m.end()
    body = line[start:]
    if body.lstrip()[:1] == '"' and (m := _WRAPPED.match(body)) and len(m[1]) > 2:
        start += m.start(1)
        body = m[1]
    if "\\" not in body:
        yield start, body
        return
    cuts = {m.end() for m in _VALUE_OPEN.finditer(body)}
    marks = sorted({(x, x) for x in cuts} | {m.span() for m in _ESCAPED_BREAK.finditer(body)})
    at = 0
    for a, b in marks:
        if a > at:
            yield start + at, body[at:a]
        at = b
    yield start + at, body[at:]


def words_of(name: str) -> list[str]:
    """The words of an identifier in lower case; written as one, ``dbpassword`` is still two."""
    words: list[str] = []
    for w in _WORDS.findall(name):
        w = w.lower()
        m = _ENDING.match(w) if w not in SECRET_WORDS and w not in OTHER_WORDS else None
        words += [m[1], m[2]] if m else [w]
    return words


def _secret_name(words: list[str]) -> bool:
    return bool(words) and not SECRET_WORDS.isdisjoint(words)


def _names_a_secret(words: list[str]) -> bool:
    """Whether the name as a whole is that of a secret: its last word counts most."""
    if not words:
        return False
    last = words[-1]
    if last in ("key", "keys"):
        return len(words) > 1 and not {"public", "primary", "foreign", "sort", "cache", "partition", "header", "operation", "map"} & set(words)
    if last in OTHER_WORDS or {"max", "min", "err", "page", "next", "file", "public"} & set(words):
        return False
    return last in SECRET_WORDS or _secret_name(words)


def _holds_a_phrase(words: list[str]) -> bool:
    """Whether the name is that of a secret that may have blanks."""
    return bool(words) and words[-1] in PHRASE_WORDS


def candidates(line: str, previous: str = "", continued: bool = False) -> list[Candidate]:
    """All literals of a statement that could be secrets; ``previous`` is the name given on the line
    before to a value that stands alone. In a statement that is ``continued`` from a literal and a plus
    sign on the line before, the first literal is a further piece of that value and begins none."""
    found: dict[tuple[int, int], Candidate] = {}

    def add(start: int, end: int, name: str, how: str) -> None:
        value = line[start:end]
        if value and (start, end) not in found:
            found[(start, end)] = Candidate(start, end, value, name, how)

    if "-----BEGIN" in line:
        for m in _PRIVATE.finditer(line):
            add(m.start(), m.end(), "private key", "pem")
    quoted = '"' in line or "'" in line or "`" in line
    low = line.lower()
    if "://" in line:
        for m in _USERINFO.finditer(line):
            g = 2 if m[2] is not None else 4
            add(m.start(g), m.end(g), "url password", "userinfo")
        for m in _QUERY.finditer(line):
            add(m.start(2), m.end(2), m[1], "query")
    if ";" in line and "=" in line:
        for m in _CONNECTION.finditer(line):
            add(m.start(2), m.end(2), m[1], "connection")
    for m in _SCHEME.finditer(line) if any(map(line.__contains__, _SCHEME_WORDS)) else ():
        add(m.start(2), m.end(2), m[1] + " authorization", "scheme")
    if "-" in line:
        for m in _FLAG.finditer(line):
            add(m.start(2), m.end(2), m[1], "flag")
    for m in _IDENTIFIED.finditer(line) if quoted and ("identified" in low or "password" in low) else ():
        add(m.start(2), m.end(2), "password", "sql")
    if "<" in line:
        for m in _ELEMENT.finditer(line):
            add(m.start(2), m.end(2), m[1], "element")
        for m in _ATTRIBUTES.finditer(line):
            add(m.start(2), m.end(2), m[1], "element")
    if quoted:
        strings = list(_STRING.finditer(line))
        for k, m in enumerate(strings):
            start, end = m.span(3)
            text = m[3]
            if not text or len(text) < 3:
                continue
            if "://" in text:
                continue
            left = line[: m.start()]
            if continued and not left.strip():
                continue
            name, how = _name_before(left, strings[:k])
            if how == "alone" and previous and not left.strip():
                name, how = previous, "assigned"
            if " " in text and not (how == "assigned" and _holds_a_phrase(words_of(name))):
                continue
            add(start, end, name, how)
    for m in _USER_OPTION.finditer(line) if "-" in line and ":" in line else ():
        add(m.start(2), m.end(2), "user password", "userinfo")
    for m in _NETRC.finditer(line) if "login" in line else ():
        add(m.start(1), m.end(1), "login password", "userinfo")
    if " / " in line and (m := _PAIR.search(line)):
        add(m.start(2), m.end(2), "user password", "userinfo")
    if b := _BARE.match(line):
        name = previous if b[1].lower() in ("value", "data") and previous else b[1]
        if b[2] or b[3] and _names_a_secret(words_of(name)) and re.match(r"\s*(?:ENV|ARG)\s", line):
            add(b.start(3), b.end(3), name, "bare")
    for m in _STATED.finditer(line) if any(map(low.__contains__, _VERBS)) else ():
        if _secret_name(words_of(m[1])):
            end = m.end(2)
            while end > m.start(2) and line[end - 1] in ".;:)":
                end -= 1
            add(m.start(2), end, m[1], "stated")
    for pattern in (JWT, PREFIXED) if _LONG.search(line) else ():
        for m in pattern.finditer(line):
            if not any(a <= m.start() and m.end() <= b for a, b in found):
                if m.start() and (line[m.start() - 1].isalnum() or line[m.start() - 1] in "/+"):
                    continue
                add(m.start(), m.end(), "", "prefix")
    return list(found.values())


_ASSIGN_LEFT = re.compile(r"([^\W\d][\w$.-]*|[$@][\w$.-]+|\[\s*\\*[\"'`][^\"'`\\]*\\*[\"'`]\s*\])\s*(?:\\*[\"'`])?\s*\]?\s*(?::\s*[\w.\[\]&]+\s*=|:=|=>|===?|!==?|[:=])\s*(?:\[\]byte\(|\w+\(|[bfru]{1,2})?\s*\(?$")
_TUPLE_LEFT = re.compile(r"([^\W\d][\w$.-]*)\s*(?::=|=|:)\s*[\[({]\s*\\*[\"'`][^\"'`]*\\*[\"'`]\s*,\s*[bfru]?$")
_CALL_LEFT = re.compile(r"([A-Za-z_$][\w$.]*)\s*\((?:[^()]|\([^()]*\))*$")
_JOINED_LEFT = re.compile(r"\\*[\"'`]\s*(?:\+|\.\.|\\)?\s*$")


def _name_before(left: str, earlier: list[re.Match]) -> tuple[str, str]:
    """The name a string literal belongs to, by what stands to its left."""
    if (m := _JOINED_LEFT.search(left)) and earlier and ("+" in m[0] or m[0].strip("\\\"'` ") == "" and len(m[0]) < 6 and not left.rstrip().endswith((",", ":", "="))):
        a = left.rstrip().rstrip("+").rstrip()
        if a.endswith(('"', "'", "`")) and earlier and earlier[-1].end() == len(a):
            return _name_before(left[: earlier[-1].start()], earlier[:-1])[0], "piece"
    if m := _ASSIGN_LEFT.search(left):
        return m[1].strip("[]\\\"'` "), "assigned"
    if (m := _FALLBACK_LEFT.search(left)) and not left.rstrip().endswith(","):
        return m[1], "fallback"
    if (m := _TUPLE_LEFT.search(left)) and _secret_name(words_of(m[1])):
        return f"{m[1]} password", "argument"
    if m := _CALL_LEFT.search(left):
        inside = left[m.end(1) :]
        names = [e[3] for e in earlier if e.start() >= m.end(1)]
        called = m[1].split(".")[-1]
        if names and _URL.match(names[0]):
            return f"{called} client key", "argument"
        if names and re.search(r"log_?in|sign_?in|auth|connect|credential", called, re.I):
            return f"{called} password", "argument"
        if names:
            return names[-1] if len(names) == 1 else names[0], "argument"
        return m[1].split(".")[-1] + (" " + inside if len(inside) < 30 else ""), "first"
    if earlier and left.rstrip().endswith(","):
        return earlier[-1][3], "listed"
    if earlier and re.search(r"[\"'`]\s*:\s*$", left):
        return earlier[-1][3], "assigned"
    return "", "alone"


_FALLBACK_LEFT = re.compile(r"([A-Za-z_$][\w$.]*(?:\[[^\]]*\])?)\s*(?:\|\|=?|\?\?=?|\bor)\s*$")


_JOINED = re.compile(r"[\"'`]\s*\+\s*$")
_NAME_LINE = re.compile(r"^\s*-?\s*[\"']?(?:name|key)[\"']?\s*[:=]\s*[\"']?([\w.-]+)[\"']?,?\s*$")


def text_candidates(text: str, memo: dict[str, list[Candidate]] | None = None) -> Iterator[tuple[int, int, Candidate]]:
    """(line number, place of its statement in the text, candidate) of a whole text. ``memo`` keeps the
    candidates of short statements, which recur in source text; it is emptied when full."""
    at, previous, continued = 0, "", False
    for number, line in enumerate(text.split("\n"), 1):
        if not _MARKS.isdisjoint(line) or _MAYBE.search(line):
            for start, statement in segments(line):
                if previous or continued or memo is None or len(statement) > 100:
                    found = candidates(statement, previous, continued)
                else:
                    found = memo.get(statement)
                    if found is None:
                        if len(memo) >= 100_000:
                            memo.clear()
                        found = memo[statement] = candidates(statement)
                for c in found:
                    yield number, at + start, c
                m = _NAME_LINE.match(statement) if "name" in statement or "key" in statement else None
                n = _OPEN_LINE.search(statement) if not m and statement.rstrip()[-1:] in ("(", "=", "\\") else None
                previous = m[1] if m else (n[1] or n[2]) if n else ""
                continued = bool(_JOINED.search(statement)) if "+" in statement else False
        else:
            previous, continued = "", False
        at += len(line) + 1


HOW = ("pem", "userinfo", "query", "connection", "scheme", "flag", "sql", "element", "assigned", "bare", "stated", "argument", "first", "listed", "fallback", "piece", "alone", "prefix")
_CONFIG = re.compile(r"\.(?:ya?ml|env|ini|cfg|conf|toml|properties|tf|tfvars|json|xml|sh)$|^\.env|Dockerfile", re.I)
_TEST = re.compile(r"(?:^|[/_.])(?:tests?|spec|fixtures?|mocks?|examples?|testdata)(?:[/_.]|$)", re.I)


def decoded(value: str) -> str | None:
    """The text that base64 hides, if it is printable ASCII."""
    if len(value) < 8 or not _BASE64.match(value):
        return None
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if "-" in value or "_" in value else None)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() and len(text) > 4 else None


def _readable(value: str) -> bool:
    """Whether the words of an identifier or path are words: random letters change case every other
    sign, or have long runs of consonants."""
    words = _WORDS.findall(value)
    return bool(words) and sum(map(len, words)) >= 3 * len(words) and not any(_CONSONANTS.search(_ABBREVIATION.sub("", w)) for w in words)


_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))


def _counts(value: str) -> tuple[int, int, int]:
    """Numbers of digits, capitals and small letters."""
    if value.isascii():
        raw = value.encode()
        return tuple(len(raw) - len(raw.translate(None, x)) for x in (_DIGITS, _UPPER, _LOWER))  # type: ignore[return-value]
    return sum(map(str.isdigit, value)), sum(map(str.isupper, value)), sum(map(str.islower, value))


@functools.lru_cache(maxsize=50_000)
def shape(value: str) -> dict[str, float]:
    """What a value looks like, as numbers."""
    n = len(value)
    digits, upper, lower = _counts(value)
    other = n - digits - upper - lower
    return {
        "length": math.log1p(n) / 4,
        "short": float(n < 6),
        "digits": digits / n,
        "any digit": float(digits > 0),
        "upper": upper / n,
        "other": other / n,
        "classes": (bool(digits) + bool(upper) + bool(lower) + bool(other)) / 4,
        "entropy": -sum(c / n * math.log2(c / n) for c in Counter(value).values()) / 6,
        "placeholder": float(bool(_PLACEHOLDER.match(value))),
        "reference": float(bool(_DOTTED.match(value)) and not PREFIXED.match(value) and not JWT.match(value) and "=" not in value and (not digits and any(x in value for x in ".([") or (not digits or "." in value) and _readable(value))),
        "path": float(bool(_PATH.match(value)) and (n < 12 or _readable(value))),
        "url": float(bool(_URL.match(value))),
        "number": float(value.replace(".", "", 1).replace("_", "").isdigit()),
        "prefixed": float(bool(PREFIXED.fullmatch(value) or JWT.fullmatch(value))),
        "uuid": float(bool(_UUID.match(value))),
        "hex": float(bool(_HEXADECIMAL.match(value))),
        "base64": float(bool(_BASE64.match(value)) and n >= 20),
        "encoded": float(decoded(value) is not None),
        "digest": float(value[:7].lower() in ("sha256:", "sha384-", "sha512-", "sha256-") or value.startswith(("W/", "data:", "sha1:", "md5:"))),
    }


def features(value: str, name: str, how: str, config: bool, test: bool, likelihood: float) -> list[float]:
    """The features of one candidate; ``likelihood`` is the Markov log ratio per character, ``config`` and
    ``test`` tell whether its file is one of configuration or of tests."""
    words = words_of(name)
    seen = shape(value)
    secret = _names_a_secret(words)
    told = float(seen["placeholder"] or seen["reference"] or seen["path"] or seen["url"] or seen["number"] or seen["digest"])
    return [
        max(-3.0, min(3.0, likelihood)),
        *seen.values(),
        float(secret),
        float(bool(words) and not STRONG_WORDS.isdisjoint(words)),
        float(bool(words) and words[-1] in OTHER_WORDS),
        float(not words),
        float(not secret and not seen["prefixed"]),
        told,
        float(config),
        float(test),
        *[float(how == h) for h in HOW],
    ]


_HELD = ("userinfo", "connection", "scheme", "sql")


def weak_label(value: str, name: str, how: str) -> int | None:
    """1 for what a pattern calls a secret, 0 for what says it is something else, else None."""
    if how == "pem":
        return 1
    words = words_of(name)
    seen = shape(value)
    if seen["placeholder"] or seen["path"] or seen["url"] or seen["number"] or seen["digest"]:
        return 0
    if seen["prefixed"]:
        return 1
    if how in _HELD:
        return 1 if len(value) >= 5 and not seen["reference"] else None
    secret = _names_a_secret(words)
    if seen["reference"]:
        return 0
    if secret and how not in ("listed", "alone", "first"):
        return 1 if len(value) >= 5 and (seen["any digit"] or seen["classes"] > 0.5) else None
    if words and not secret:
        return 0
    return None


def _symbols(value: str) -> np.ndarray:
    """Printable ASCII as 1 to 95, all else as 0."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 31, 0)


class Markov(NamedTuple):
    """Log probabilities of a character after another, for secrets and for other literals."""

    secret: np.ndarray
    other: np.ndarray

    def ratio(self, value: str) -> float:
        """Mean log likelihood ratio of a whole value; 0 for single characters."""
        symbols = _symbols(value)
        if len(symbols) < 2:
            return 0.0
        a, b = symbols[:-1], symbols[1:]
        return float((self.secret[a, b] - self.other[a, b]).mean())

    @staticmethod
    def of(counts: dict[tuple[int, int], int]) -> Markov:
        """From counts by (label, 96 * first + second), with add-one smoothing."""
        tables = []
        for label in (1, 0):
            t = np.ones((96, 96))
            for (kind, pair), n in counts.items():
                if kind == label:
                    t[pair // 96, pair % 96] += n
            tables.append(np.log(t / t.sum(axis=1, keepdims=True)))
        return Markov(*tables)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    penalty = np.full(x.shape[1], ridge * len(y) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model(NamedTuple):
    """A fitted classifier: chains, weights, and the line that calibrates the scores."""

    markov: Markov
    weights: np.ndarray
    scale: float
    shift: float

    def probability(self, value: str, name: str, how: str, config: bool, test: bool, memo: dict | None = None) -> float:
        """Calibrated probability that a candidate is a credential; ``memo`` keeps those of literals that
        recur, and is emptied when full. Without weights, only the BEGIN line of a private key is one."""
        key = (value, name, how, config, test)
        if memo is not None and key in memo:
            return memo[key]
        if len(self.weights):
            x = np.array([*features(value, name, how, config, test, self.markov.ratio(value)), 1.0])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * float(x @ self.weights) + self.shift))))
        else:
            p = float(how == "pem")
        if memo is not None:
            if len(memo) >= 100_000:
                memo.clear()
            memo[key] = p
        return p

    def spans(self, text: str | None, path: str | None, threshold: float = THRESHOLD, memo: dict | None = None, statements: dict | None = None) -> list[tuple[int, int, int]]:
        """(line number, start, end) of the credentials in a text."""
        found = []
        kind = file_kind(path)
        for number, at, c in text_candidates(text or "", statements):
            if self.probability(c.value, c.name, c.how, *kind, memo) >= threshold:
                end = at + c.end
                if c.how == "pem" and (close := re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----").search(text, end)):
                    end = close.end()
                found.append((number, at + c.start, end))
        return found


def file_kind(path: str | None) -> tuple[bool, bool]:
    """Whether a file is one of configuration, and whether one of tests."""
    return bool(_CONFIG.search(path or "")), bool(_TEST.search(path or ""))


def candidate_rows(rows: DataFrame, key: str, text: str = "code", path: str | None = "file") -> DataFrame:
    """``key, line_no, value, name, how, config, test, label`` of every candidate of every text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, labels = {}, {}
        for b in batches:
            place, out = [], []
            for n, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                kinds = file_kind(p)
                for number, _, c in text_candidates(t or "", memo):
                    literal = (c.value, c.name, c.how)
                    if literal not in labels:
                        if len(labels) >= 100_000:
                            labels.clear()
                        labels[literal] = weak_label(*literal)
                    place.append(n)
                    out.append((number, *literal, *kinds, labels[literal]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, "line_no", "value", "name", "how", "config", "test", "label"])

    source = rows.select(F.col(key), F.col(text).alias("__t"), (F.col(path) if path else F.lit(None)).cast("string").alias("__p"))
    return spread(source).mapInArrow(run, f"`{key}` {kind}, line_no int, value string, name string, how string, config boolean, test boolean, label int")


def fit(found: DataFrame, sample: int = MAX_TRAINING_ROWS) -> Model:
    """Fits the classifier on the weak labels of ``candidate_rows``.

    Character chains are counted over all different labelled literals; the regression is fitted on at
    most ``sample`` of them, as many of either label, chosen by hash, a quarter of which is held out for
    calibration. Without literals of both kinds the model finds private key blocks only.
    """
    literal = ["value", "name", "how", "config", "test", "label"]
    labelled = found.where("label IS NOT NULL").select(*literal).distinct().persist(StorageLevel.MEMORY_AND_DISK)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 96 * 96), np.int64)
        total = [0, 0]
        for b in batches:
            for value, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                symbols = _symbols(value)
                np.add.at(counts[label], 96 * symbols[:-1] + symbols[1:], 1)
                total[label] += 1
        at = np.nonzero(counts)
        columns = [[*at[0].tolist(), 0, 1], [*at[1].tolist(), -1, -1], [*counts[at].tolist(), *total]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["label", "pair", "n"])

    counted = labelled.select("value", "label").mapInArrow(pairs, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = {(r.label, r.pair): r.n for r in counted.collect()}  # at most 2 * 96 * 96 rows
    total = {k: counts.pop((k, -1), 0) for k in (0, 1)}
    markov = Markov.of(counts)
    if not all(total.values()):
        labelled.unpersist()
        return Model(markov, np.zeros(0), 1.0, 0.0)
    order = F.shiftrightunsigned(F.xxhash64("value", "name", "how", "config", "test"), 1)
    keep = F.lit(False)
    for k, n in total.items():  # both classes get the same room
        share = min(1.0, sample / 2 / n * 0.95)
        keep = keep | ((F.col("label") == k) & (order <= F.lit(min(2**63 - 1, int(2**63 * share)))))
    rows = labelled.where(keep).withColumn("h", order).orderBy("h", *literal[:-1]).limit(sample).collect()
    labelled.unpersist()
    x = np.array([features(r.value, r.name, r.how, r.config, r.test, markov.ratio(r.value)) for r in rows])
    y = np.array([float(r.label) for r in rows])
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
    fitted = ~held if 0 < y[~held].sum() < (~held).sum() else np.ones(len(y), bool)
    weights = fit_logistic(x[fitted], y[fitted])
    scores = np.hstack([x[held], np.ones((held.sum(), 1))]) @ weights
    if 0 < y[held].sum() < held.sum():
        scale, shift = fit_logistic(scores[:, None], y[held], ridge=1e-3)
    else:
        scale, shift = 1.0, 0.0
    return Model(markov, weights, float(max(scale, 1e-3)), float(shift))


def train(rows: DataFrame, text: str = "code", path: str | None = "file", sample: int = MAX_TRAINING_ROWS) -> Model:
    """Fits the classifier on the texts of ``rows``, for use on others."""
    return fit(candidate_rows(rows.select(F.lit(0).alias("__k"), F.col(text), *([path] if path else [])), "__k", text, path), sample)


def score(found: DataFrame, key: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``key, line_no`` of the lines of ``candidate_rows`` on which a credential begins, each once."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            at = [n for n, c in enumerate(zip(*[b.column(i).to_pylist() for i in range(2, 7)], strict=True)) if model.probability(*c, memo) >= threshold]
            yield b.select([key, "line_no"]).take(pa.array(at, pa.int64()))

    return found.select(key, "line_no", "value", "name", "how", "config", "test").mapInArrow(run, f"`{key}` {kind}, line_no int").distinct()


def find_credentials(rows: DataFrame, model: Model, key: str, text: str = "code", path: str | None = "file", threshold: float = THRESHOLD) -> DataFrame:
    """``key, line_no`` of every line on which a credential begins, each once, by a fitted model.

    Lines are counted from 1 and split at ``\\n``. Null and empty texts have none; a text of any length
    is read whole, line by line. ``path`` is an optional column with the file's path, null allowed.
    """
    return score(candidate_rows(rows, key, text, path), key, model, threshold)


def detect(rows: DataFrame, key: str, text: str = "code", path: str | None = "file", sample: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``find_credentials`` by a model fitted on the same texts, which are read once.

    The candidates stay with the executors, which release them before this returns; those of a lost
    executor are read again.
    """
    found = candidate_rows(rows, key, text, path).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut_lineage(score(found, key, fit(found, sample), threshold))
    finally:
        found.unpersist()


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = REDACTED) -> str | None:
    """The text with the spans replaced; line breaks inside a span stay, so that lines keep their numbers."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], mark + "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


def redact_credentials(rows: DataFrame, model: Model, text: str = "code", path: str | None = "file", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with the credentials in ``text`` blanked out and all else as it was."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, statements = {}, {}
        for b in batches:
            at = names.index(text)
            paths = b.column(names.index(path)).to_pylist() if path else [None] * b.num_rows
            blank = [redact(t, model.spans(t, p, threshold, memo, statements)) for t, p in zip(b.column(at).to_pylist(), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blank, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return rows.mapInArrow(run, rows.schema)
