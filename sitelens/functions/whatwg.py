"""Per-value URL helper for the slow path (pure Python, no Spark).

Implements the parts of the WHATWG URL algorithm that reference resolution
needs: scheme detection, special-scheme authority handling, host lowercasing
and IDNA, default-port removal, dot-segment removal (including ``%2e``),
per-component percent-encoding that leaves existing escapes alone, and
relative resolution against a base. ``decode_uri`` is ECMAScript
``decodeURI``. Every function is total: bad input gives ``None``.

Used by pandas UDFs only for values the native column expressions in
``sitelens.functions.urls`` do not cover.
"""

from __future__ import annotations

import re

# Fixed values from the URL standard.
SPECIAL_PORTS = {"ftp": "21", "file": None, "http": "80", "https": "443", "ws": "80", "wss": "443"}
C0 = {chr(i) for i in range(0x20)} | {"\x7f"}
FRAGMENT_SET = C0 | {" ", '"', "<", ">", "`"}
QUERY_SET = C0 | {" ", '"', "#", "<", ">"}
SPECIAL_QUERY_SET = QUERY_SET | {"'"}
PATH_SET = QUERY_SET | {"?", "`", "{", "}"}
USERINFO_SET = PATH_SET | {"/", ":", ";", "=", "@", "[", "\\", "]", "^", "|"}
FORBIDDEN_HOST = set("\x00\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | C0 | {"%", "\x7f"}
# decodeURI leaves escapes of these characters encoded.
URI_RESERVED = set(";/?:@&=+$,#")

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_TRIM = "".join(chr(i) for i in range(0x21))


def _encode(s: str, charset: set[str]) -> str:
    out = []
    for ch in s:
        if ch in charset or ord(ch) > 0x7E:
            out.append("".join(f"%{b:02X}" for b in ch.encode("utf-8", "surrogatepass")))
        else:
            out.append(ch)
    return "".join(out)


def _pct_decode_bytes(s: str) -> bytes:
    raw = s.encode("utf-8", "surrogatepass")
    out = bytearray()
    i = 0
    while i < len(raw):
        c = raw[i]
        if c == 0x25 and i + 2 < len(raw) + 0 and re.match(rb"[0-9A-Fa-f]{2}", raw[i + 1:i + 3]):
            out.append(int(raw[i + 1:i + 3], 16))
            i += 3
        else:
            out.append(c)
            i += 1
    return bytes(out)


def _host(raw: str, special: bool) -> str | None:
    if raw.startswith("["):
        return raw.lower() if raw.endswith("]") else None
    if not special:
        if any(ch in FORBIDDEN_HOST for ch in raw):
            return None
        return _encode(raw, C0)
    try:
        domain = _pct_decode_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    domain = domain.lower()
    if any(ord(ch) > 0x7F for ch in domain):
        try:
            domain = ".".join(
                lab if all(ord(c) < 0x80 for c in lab) else "xn--" + lab.encode("punycode").decode("ascii")
                for lab in domain.split("."))
        except UnicodeError:
            return None
    if domain == "" or any(ch in FORBIDDEN_DOMAIN for ch in domain):
        return None
    if re.fullmatch(r"\d+(\.\d+){3}", domain):
        parts = [int(p) for p in domain.split(".")]
        if any(p > 255 for p in parts):
            return None
        domain = ".".join(str(p) for p in parts)
    return domain


def _is_single_dot(seg: str) -> bool:
    return seg == "." or seg.lower() == "%2e"


def _is_double_dot(seg: str) -> bool:
    return seg.lower() in ("..", ".%2e", "%2e.", "%2e%2e")


def _normalize_path(segments: list[str], special: bool) -> list[str]:
    out: list[str] = []
    n = len(segments)
    for i, seg in enumerate(segments):
        last = i == n - 1
        if _is_double_dot(seg):
            if out:
                out.pop()
            if last:
                out.append("")
        elif _is_single_dot(seg):
            if last:
                out.append("")
        else:
            out.append(_encode(seg, PATH_SET))
    return out


class _URL:
    __slots__ = ("scheme", "userinfo", "host", "port", "path", "opaque", "query", "fragment")

    def __init__(self):
        self.scheme = ""
        self.userinfo = ""
        self.host = None
        self.port = None
        self.path: list[str] = []
        self.opaque = None
        self.query = None
        self.fragment = None

    def href(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//"
            if self.userinfo:
                out += self.userinfo + "@"
            out += self.host
            if self.port is not None:
                out += ":" + self.port
        if self.opaque is not None:
            out += self.opaque
        else:
            if self.host is None and len(self.path) > 1 and self.path[0] == "":
                out += "/."
            out += "".join("/" + s for s in self.path)
        if self.query is not None:
            out += "?" + self.query
        if self.fragment is not None:
            out += "#" + self.fragment
        return out


def _split_rest(rest: str):
    frag = query = None
    if "#" in rest:
        rest, frag = rest.split("#", 1)
    if "?" in rest:
        rest, query = rest.split("?", 1)
    return rest, query, frag


def _parse_authority(u: _URL, auth: str, special: bool) -> bool:
    if "@" in auth:
        cred, auth = auth.rsplit("@", 1)
        u.userinfo = ":".join(_encode(p, USERINFO_SET) for p in cred.split(":", 1))
        if u.userinfo == ":":
            u.userinfo = ""
    port = None
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", auth)
    if not m:
        return False
    hostpart, port = m.group(1), m.group(2)
    if special and hostpart == "":
        return u.scheme == "file"
    host = _host(hostpart, special)
    if host is None:
        return False
    u.host = host
    if port:
        if int(port) > 65535:
            return False
        port = str(int(port))
        if SPECIAL_PORTS.get(u.scheme) == port:
            port = None
        u.port = port
    return True


def parse(text: str | None, base: str | None = None) -> _URL | None:
    if text is None:
        return None
    s = text.strip(_TRIM).replace("\t", "").replace("\n", "").replace("\r", "")
    b = parse(base) if base is not None else None
    if base is not None and b is None:
        return None
    m = _SCHEME.match(s)
    u = _URL()
    if m:
        scheme = m.group(1).lower()
        rest = s[m.end():]
        special = scheme in SPECIAL_PORTS
        if special:
            rest = rest.replace("\\", "/")
            if b is not None and b.scheme == scheme and not rest.startswith("/"):
                return _relative(rest, b, special)
            rest = rest.lstrip("/") if scheme != "file" else rest
            u.scheme = scheme
            if scheme == "file":
                rest = rest[2:] if rest.startswith("//") else rest
            path_start = len(rest)
            for i, ch in enumerate(rest):
                if ch in "/?#":
                    path_start = i
                    break
            auth, rest = rest[:path_start], rest[path_start:]
            if not _parse_authority(u, auth, True):
                return None
            path, u.query, u.fragment = _split_rest(rest)
            segs = path.split("/")[1:] if path.startswith("/") else ([path] if path else [""])
            u.path = _normalize_path(segs, True) or [""]
        else:
            u.scheme = scheme
            if rest.startswith("//"):
                rest = rest[2:]
                path_start = len(rest)
                for i, ch in enumerate(rest):
                    if ch in "/?#":
                        path_start = i
                        break
                auth, rest = rest[:path_start], rest[path_start:]
                if not _parse_authority(u, auth, False):
                    return None
                path, u.query, u.fragment = _split_rest(rest)
                u.path = _normalize_path(path.split("/")[1:], False) if path else []
            elif rest.startswith("/"):
                path, u.query, u.fragment = _split_rest(rest)
                u.path = _normalize_path(path.split("/")[1:], False)
            else:
                path, u.query, u.fragment = _split_rest(rest)
                u.opaque = _encode(path, C0)
        if u.query is not None:
            u.query = _encode(u.query, SPECIAL_QUERY_SET if special else QUERY_SET)
        if u.fragment is not None:
            u.fragment = _encode(u.fragment, FRAGMENT_SET)
        return u
    if b is None:
        return None
    return _relative(s, b, b.scheme in SPECIAL_PORTS)


def _relative(s: str, b: _URL, special: bool) -> _URL | None:
    if special:
        s = s.replace("\\", "/")
    u = _URL()
    u.scheme = b.scheme
    if b.opaque is not None:
        if not s.startswith("#"):
            return None
        u.opaque, u.query = b.opaque, b.query
        u.fragment = _encode(s[1:], FRAGMENT_SET)
        return u
    if s.startswith("//"):
        return parse(b.scheme + ":" + s)
    u.userinfo, u.host, u.port = b.userinfo, b.host, b.port
    path, query, frag = _split_rest(s)
    if path == "":
        u.path = list(b.path)
        u.query = b.query if query is None else query
    elif path.startswith("/"):
        u.path = _normalize_path(path.split("/")[1:], special)
        u.query = query
    else:
        merged = b.path[:-1] + path.split("/")
        u.path = _normalize_path(merged, special)
        u.query = query
    if special and not u.path:
        u.path = [""]
    if query is not None:
        u.query = _encode(query, SPECIAL_QUERY_SET if special else QUERY_SET)
    u.fragment = None if frag is None else _encode(frag, FRAGMENT_SET)
    return u


def resolve(ref: str | None, base: str | None = None) -> str | None:
    """``new URL(ref, base).href``; ``None`` where the constructor throws."""
    try:
        u = parse(ref, base)
        return None if u is None else u.href()
    except Exception:  # total: a bad value never fails the task
        return None


def decode_uri(s: str | None) -> str | None:
    """ECMAScript decodeURI; ``None`` where it throws URIError."""
    if s is None:
        return None
    out = []
    i, n = 0, len(s)
    while i < n:
        ch = s[i]
        if ch != "%":
            out.append(ch)
            i += 1
            continue
        start = i
        bs = bytearray()
        while i < n and s[i] == "%":
            h = s[i + 1:i + 3]
            if len(h) < 2 or not re.fullmatch(r"[0-9A-Fa-f]{2}", h):
                return None
            bs.append(int(h, 16))
            i += 3
        # decode byte run one character at a time, keeping reserved escapes
        j = 0
        text_start = start
        while j < len(bs):
            b0 = bs[j]
            if b0 < 0x80:
                c = chr(b0)
                out.append(s[text_start + 3 * j:text_start + 3 * j + 3] if c in URI_RESERVED else c)
                j += 1
                continue
            width = 2 if b0 >> 5 == 0b110 else 3 if b0 >> 4 == 0b1110 else 4 if b0 >> 3 == 0b11110 else 0
            if width == 0 or j + width > len(bs):
                return None
            try:
                out.append(bytes(bs[j:j + width]).decode("utf-8"))
            except UnicodeDecodeError:
                return None
            j += width
    return "".join(out)


def report_key(url: str | None) -> str | None:
    """``decodeURI(new URL(url).href)``: the form an asset url is reported in."""
    href = resolve(url)
    return None if href is None else decode_uri(href)


def pathname(href: str | None) -> str | None:
    """``new URL(href).pathname`` of an already serialised URL."""
    u = parse(href)
    if u is None:
        return None
    if u.opaque is not None:
        return u.opaque
    return "".join("/" + s for s in u.path)


def queue_key(href: str | None) -> str | None:
    """A resolved href with its fragment cleared."""
    if href is None:
        return None
    return href.split("#", 1)[0]
