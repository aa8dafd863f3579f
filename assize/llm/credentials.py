"""Credentials embedded in source code and configuration.

A keyword automaton over the lower-cased text decides whether a text is looked
at at all. Then issuer formats, structures (private-key blocks, connection
strings, addresses with passwords, headers) and assignments to sensitive names
are matched by regular expression, and each match is validated: structure and
alphabet of issued tokens, body of a key block, and, for assignments, that the
value is a literal and no placeholder, reference, pattern, prose, digest or
identifier. Matches are replaced by placeholders of the same length and
alphabet, so the code around them stays valid.

One pass over the texts, no shuffle.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words before a user and password (fixed values).
_LOGIN_WORDS = ("login", "log in", "credential", "credentials", "creds", "account")
#: Strings of which one occurs (in lower case) in every text with a credential (fixed values).
KEYWORDS = (
    *_LOGIN_WORDS,
    "pass", "pwd", "pw", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "private key", "bearer",
    "basic", "auth", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-",
    "sk_live_", "rk_live_", "sk-", "xox", "aiza", "npm_", "sg.", "eyj", "://", "hvs.", "dop_v1_", "sig=", "signature", "key",
)

#: Formats of issuers: name, pattern (fixed values).
ISSUED = (
    ("aws_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_fine", r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{60,}(?![A-Za-z0-9])"),
    ("gitlab", r"(?<![A-Za-z0-9_])glpat-[A-Za-z0-9_\-]{20,}"),
    ("payment", r"(?<![A-Za-z0-9_])[sr]k_live_[A-Za-z0-9]{16,}(?![A-Za-z0-9])"),
    ("model", r"(?<![A-Za-z0-9_\-])sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{28,}(?![A-Za-z0-9])"),
    ("chat", r"(?<![A-Za-z0-9_\-])xox[abeoprs]-[0-9]+-[0-9A-Za-z\-]{12,}"),
    ("google", r"(?<![A-Za-z0-9_\-])AIza[0-9A-Za-z_\-]{35}(?![A-Za-z0-9_\-])"),
    ("npm", r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("mail", r"(?<![A-Za-z0-9_])SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    ("vault", r"(?<![A-Za-z0-9_])hvs\.[A-Za-z0-9_\-]{24,}"),
    ("hosting", r"(?<![A-Za-z0-9_])dop_v1_[0-9a-f]{64}"),
    ("jwt", r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
)
_ISSUED = re.compile("|".join(f"(?P<{n}>{p})" for n, p in ISSUED))

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?<=[A-Za-z0-9+.\-])://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s/@\"'`<>]+)@[A-Za-z0-9\[]")
_HEADER = re.compile(r"(?i:\b(?:authorization\s*[:=]\s*[\"']?\s*)?(?:basic|bearer))\s+(?P<value>[A-Za-z0-9+/._~\-]{16,}={0,2})")
_CONNECTION = re.compile(r"(?i:\b(?:password|pwd))\s*=\s*(?P<value>[^;\"'`\s]+)\s*;|;\s*(?i:password|pwd)\s*=\s*(?P<last>[^;\"'`\s]+)")
_QUERY = re.compile(r"[?&](?i:access_token|auth_token|token|api_?key|secret|password|client_secret)=(?P<value>[A-Za-z0-9._~%+/\-]{8,})")

#: Sensitive words as they end a name (fixed values).
_SENSITIVE = r"(?:(?:^|[_\-])pass|password|passwd|passphrase|pwd|(?:^|[_\-])pw|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|signing[_\-]?key|encryption[_\-]?key|credentials?)"
_HINT = re.compile(r"(?i)pass|pwd|pw|secret|token|key|credential")
_NAME = re.compile(rf"(?i){_SENSITIVE}[_\-]?(?:value|key|str|string|text|\d+)?$")
#: Names of counts and of things that are public (fixed values).
_NOT_NAME = re.compile(r"(?i)(?:^|[_\-])(?:max|min|num|n|total|used|per|input|output|public)[_\-]?(?:tokens?|key)$|tokens$|bypass$|compass$")

_STRING = r"(?:[rbuf]{0,2})(?:\"\"\"(?P<a>.*?)\"\"\"|\"(?P<b>(?:[^\"\\\n]|\\.)*)\"|'(?P<c>(?:[^'\\\n]|\\.)*)'|`(?P<d>[^`]*)`)"
#: What stands between a name and the literal given to it: closing quotes and brackets, a type, an operator, a conversion.
_GIVEN = re.compile(
    r"[\"'`\]]{0,2}(?:[ \t]*|\s{0,3})(?::\s{0,2}&?(?:'static\s)?[A-Za-z_][\w<>&]*+(?:[ \t]*|\s{0,2})(?==))?(?::=|=>|=|:|,)\s*+(?:[A-Za-z_][\w:]*+\()?" + _STRING, re.S
)
_TICKED = re.compile(r"`\s+(?:`(?P<d>[^`\n]+)`|\"(?P<b>[^\"\n]+)\"|'(?P<c>[^'\n]+)')")
_ATTRIBUTE = re.compile(r"\"\s+value\s*=\s*\"(?P<b>[^\"\n]+)\"")
_MORE = re.compile(r"\s*(?:\+|\.\.|\\\n)?\s*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
_BARE = re.compile(r"(?:[ \t]*|\s{0,2})(?P<op>=|:)[ \t]*+(?P<value>[^\s\"'`,;(){}\[\]<>][^\s\"'`,;()<>]*)(?P<rest>[^\n]*)")
_LOGIN = re.compile(rf"(?i:\b(?:{'|'.join(_LOGIN_WORDS)})\s*+(?:(?:is|are|:|=)\s*+)?)(?P<user>[A-Za-z0-9_.@\-]++)\s*+/\s*+(?P<value>[^\s\"'`/,;]{{6,}})")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:|x+|\*+|\.+|-+|_+|0+|#+|todo|tbd|fixme|none|null|nil|undefined|true|false|change[_\-]?me|changeit|redacted|removed|masked|hidden|example|sample|dummy|placeholder|secret|password|token|test|admin|root|user|n/?a)$"
    r"|<[^>]*>|\[[^\]]*\]|\{\{|\}\}|\$\{|\$\(|%\(|%[sdv]|\{[A-Za-z_.]*\}|^\$[A-Za-z_]|^%[A-Za-z_]+%$|your[_\- ]|[_\-]here$|insert[_\- ]|replace[_\- ]|redacted|example|placeholder|dummy|change[_\-]?me|not[_\-]?a[_\-]?real|fake|xxxx|\*\*\*|\.\.\.|…"
)
_REFERENCE = re.compile(r"(?i)^(?:os\.|process\.|env[.:(\[]|std::env|system\.|var\.|local\.|module\.|data\.|self\.|this\.|config[.\[]|settings[.\[]|secrets?\.|vault[:.]|ssm:|arn:|file:|ref:|getenv|get_|load_|read_|fetch_|[A-Za-z_][\w.]*\()|\benviron\b|getenv|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$")
_PATTERN = re.compile(r"\[[^\]]*\][{+*]|\\[dwsbDWSB]|\(\?[:=!<]|\{\d+,?\d*\}|\.\*|\.\+")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[-:$]|^\$(?:2[aby]|argon2\w*|pbkdf2\w*|scrypt|5|6|1|y)\$|^\{?(?:ssha|bcrypt)\}?|^data:")


def literal(value: str) -> bool:
    """Whether a value given to a sensitive name is a usable credential."""
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.search(v) or _REFERENCE.search(v) or _PATTERN.search(v) or _UUID.match(v) or _DIGEST.search(v):
        return False
    if len(set(v)) < 4 or re.fullmatch(r"\d{1,9}", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[_.\- ][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|(?:[A-Z]?[a-z]+)+", v) and len(v) < 20:
        return False  # a word or an identifier
    return not re.fullmatch(r"[A-Za-z]+(?:_[A-Za-z]+)+", v)


def _issued(kind: str, value: str) -> bool:
    body = re.sub(r"^(?:AKIA|ASIA|gh\w_|github_pat_|glpat-|[sr]k_live_|sk-(?:proj-|ant-)?|xox\w-|AIza|npm_|SG\.|hvs\.|dop_v1_|eyJ)", "", value)
    if len(set(body)) < 6 or re.search(r"(?i)example|x{6,}|your|placeholder|redacted|dummy|test_?key", body):
        return False
    # Issued tokens are random; a run of words is a name that only starts like one.
    return kind == "aws_key_id" or bool(re.search(r"\d", body)) or len(re.findall(r"[A-Z]", body)) > 2


def _sensitive(key: str) -> bool:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key.rsplit(".", 1)[-1])
    return bool(_NAME.search(name)) and not _NOT_NAME.search(name)


#: What may stand around the lines of a key block in code: quotes, joins, comment signs.
_AROUND = " \t\r\"'`+,;|#*\\"
_SEGMENT = re.compile(r"\\r|\\n|\r|\n")
_TOKEN = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_KEY_HEADER = re.compile(r"[A-Z][A-Za-z0-9\-]*: ")


def _key_block(text: str, begin: int) -> tuple[int, list[tuple[int, int]]] | None:
    """End of the key block whose first line ends at ``begin``, and the places of its key material; None if it has none.

    A block runs to its END line. Without one it ends at its last line of key
    material: whatever is neither that, nor a header, nor blank, is other code.
    """
    limit = text.find("-----", begin)
    limit = len(text) if limit < 0 else limit
    closed = text.startswith("-----END", limit)
    places: list[tuple[int, int]] = []
    material, width, at = False, 0, begin
    while at < limit:
        m = _SEGMENT.search(text, at, limit)
        stop = m.start() if m else limit
        core = text[at:stop].strip(_AROUND)
        tokens = core.split()
        if tokens and all(_TOKEN.fullmatch(t) for t in tokens):
            longest = max(map(len, tokens))
            last = longest < 16
            # A short line can only be the last one of the material, and no plain word.
            if not last or (width and not core.islower() and not core.isalpha()) or core.endswith("="):
                start = text.index(core, at, stop)
                places.append((start, start + len(core)))
                material |= any(len(t) >= 24 and len(set(t)) > 8 for t in tokens)
                width = 0 if last else longest
            elif not closed:
                break
            if last and not closed:
                break
        elif core and not closed and not _KEY_HEADER.match(core):
            break
        else:
            width = 0
        at = m.end() if m else limit
    return (limit if closed else places[-1][1], places) if material else None


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sensitive names."""
    done = 0
    part = lambda ch: ch.isalnum() or ch in "_-."
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        s, e = m.start(), m.end()
        while s > done and part(text[s - 1]):
            s -= 1
        while e < len(text) and part(text[e]):
            e += 1
        done = e
        if _sensitive(text[s:e].strip("-.")):
            yield s, e


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Places of literals given to sensitive names."""
    for s, e in _names(text):
        m = _GIVEN.match(text, e) or _TICKED.match(text, e) or _ATTRIBUTE.match(text, e)
        if m:
            name = next(g for g, v in m.groupdict().items() if v is not None)
            start, end, whole = m.start(name), m.end(name), m[name]
            at = m.end()
            while more := _MORE.match(text, at):
                if "+" not in more.group() and ".." not in more.group() and not more.group().startswith(("\"", "'", " \"", " '")):
                    break
                whole += more[1] or more[2] or ""
                at = end = more.end()
            if literal(whole):
                yield start, end
            continue
        m = _BARE.match(text, e)
        if not m or text.startswith("::", e):
            continue
        value, rest = m["value"].rstrip(".,;)"), m["rest"].strip()
        if m["op"] == ":" and rest and not rest.startswith("#"):
            continue
        if literal(value) and re.search(r"\d|[^\w.]", value):
            yield m.start("value"), m.start("value") + len(value)


def spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every usable credential, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        found.append((start, end, kind))

    for m in _PEM.finditer(text):
        if block := _key_block(text, m.end()):
            add(m.start(), block[0], "private_key")
    for m in _ISSUED.finditer(text):
        if _issued(m.lastgroup, m.group()):
            add(m.start(), m.end(), m.lastgroup)
    for m in _URL.finditer(text):
        v = m["value"]
        if not (_PLACEHOLDER.search(v) or _REFERENCE.search(v) or _PATTERN.search(v)) and len(v) >= 4 and not v.isdigit():
            add(m.start("value"), m.end("value"), "url_password")
    for m in _HEADER.finditer(text):
        if literal(m["value"]) and re.search(r"\d|[A-Z].*[a-z].*[A-Z]|=$", m["value"]):
            add(m.start("value"), m.end("value"), "header")
    for m in _CONNECTION.finditer(text):
        name = "value" if m["value"] else "last"
        if literal(m[name]):
            add(m.start(name), m.end(name), "connection_string")
    for m in _QUERY.finditer(text):
        if literal(m["value"]):
            add(m.start("value"), m.end("value"), "query")
    for s, e in _assigned(text):
        add(s, e, "assignment")
    for m in _LOGIN.finditer(text):
        if literal(m["value"]) and re.search(r"\d|[^\w]", m["value"]):
            add(m.start("value"), m.end("value"), "login")
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e, k))
    return out


def _masked(value: str) -> str:
    """As many characters of the same alphabet: hexadecimal stays so, and so do capitals with the digits 2 to 7."""

    def run(m: re.Match) -> str:
        word = m.group()
        if word[0] == "\\":
            return word
        if len(word) >= 8 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
            return re.sub("[A-F]", "A", re.sub("[a-f]", "a", re.sub("[0-9]", "0", word)))
        digit = "2" if len(word) >= 8 and re.fullmatch("[A-Z2-7]+", word) else "0"
        return re.sub("[0-9]", digit, re.sub("[A-Z]", "X", re.sub("[a-z]", "x", word)))

    return re.sub(r"\\.|[A-Za-z0-9]+", run, value)


def redact(text: str) -> str:
    """The text with every credential replaced by as many characters of its alphabet.

    Escapes, quotes, joins, line ends and all of a key block but its material stay as they are.
    """
    parts, at = [], 0
    for s, e, kind in spans(text):
        places = [(s, e)]
        if kind == "private_key":
            _, places = _key_block(text, text.index("-----", s + 5) + 5)
        for a, b in places:
            parts += [text[at:a], _masked(text[a:b])]
            at = b
    return "".join([*parts, text[at:]])


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(kind: str, value: str) -> bool | None:
    """Whether an issued token's own check holds; None for kinds without a public one.

    Tokens of the kinds github and npm end in six base-62 digits of the CRC-32 of
    the 30 characters before; a jwt begins with a JSON object that names its algorithm.
    """
    if kind in ("github", "npm"):
        body = value.split("_", 1)[1]
        crc, digits = zlib.crc32(body[:-6].encode()), ""
        for _ in range(6):
            crc, d = divmod(crc, 62)
            digits = _BASE62[d] + digits
        return body[-6:] == digits
    if kind == "jwt":
        head = value.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except ValueError:
            return False
    return None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, k)
    a.make_automaton()
    return a


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        rows: dict[str, list] = {"id": [], "hits": [], "content": [], "qualified_name": []}
        for id_, content, name in zip(*(batch[c].to_pylist() for c in ("id", "content", "qualified_name"))):
            hits = []
            for is_name, text in ((True, name), (False, content)):
                if not text or next(automaton.iter(text.lower()), None) is None:
                    continue
                line, at = 1, 0
                for s, e, kind in spans(text):
                    line += text.count("\n", at, s)
                    at = s
                    hits.append({"line_no": 0 if is_name else line, "kind": kind, "start": s, "length": e - s, "checksum": checksum(kind, text[s:e])})
                if hits and is_name:
                    name = redact(text)
                elif any(h["line_no"] for h in hits):
                    content = redact(text)
            for k, v in (("id", id_), ("hits", hits), ("content", content), ("qualified_name", name)):
                rows[k].append(v)
        hit = pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("checksum", pa.bool_())])
        types = {"id": pa.string(), "hits": pa.list_(hit), "content": pa.string(), "qualified_name": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in rows.items()], list(rows))


def scan(chunks: DataFrame) -> DataFrame:
    """One row per chunk: ``id, hits, content, qualified_name``, the texts redacted.

    ``hits`` has, per credential, ``line_no`` (0 in qualified_name, else the
    line on which it begins), ``kind``, ``start`` and ``length`` in characters,
    and ``checksum``: whether the token's own check holds, null where its kind has none.
    Null texts stay null and have no hits; a redacted text is as long as the
    original and has the same line ends. Repeated rows are scanned each.
    """
    return chunks.select("id", "content", "qualified_name").mapInArrow(
        _scan, "id string, hits array<struct<line_no:int,kind:string,start:int,length:int,checksum:boolean>>, content string, qualified_name string"
    )


def found(chunks: DataFrame) -> DataFrame:
    """``id, line_no`` of every line on which a credential begins, once each."""
    hits = scan(chunks).select("id", F.explode("hits").alias("h")).select("id", "h.line_no")
    return hits.distinct()
