"""Binary chunks of five dialects: a bounded reader, one decoder driven by a description of each format, and its inverse.

Plain Python without Spark: artifacts.py calls it once for each artifact.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed limits on what is read.
MOST_BYTES, MOST_NESTING, MOST_PROTOTYPES = 64 << 20, 128, 10_000
MOST_WORDS, MOST_WORDS_IN_ALL, MOST_CONSTANTS, MOST_UPVALUES, MOST_STRING = 1_000_000, 2_000_000, 262_144, 1_024, 16 << 20

# Fixed bytes of the headers.
SIGNATURE, DATA, TAIL_52 = b"\x1bLua", b"\x19\x93\r\n\x1a\n", b"\x19\x93\r\n\x1a\n"


class ChunkError(ValueError):
    """A chunk that can't be read: a diagnostic code, and where."""

    def __init__(self, code: str, message: str, offset: int = 0):
        super().__init__(f"{code} at {offset}: {message}")
        self.code, self.message, self.offset = code, message, offset


@dataclass
class Constant:
    ctype: str  # nil, boolean, integer, float, short-string, long-string
    value: object = None
    raw: bytes = b""  # bytes of a number, or a string
    offset: int = 0
    length: int = 0


@dataclass
class Upvalue:
    instack: int = 0
    idx: int = 0
    kind: int = 0
    name: bytes | None = None


@dataclass
class Local:
    name: bytes
    startpc: int
    endpc: int


@dataclass
class Prototype:
    source: bytes | None = None
    line_defined: int = 0
    last_line_defined: int = 0
    numparams: int = 0
    is_vararg: int = 0
    maxstacksize: int = 2
    code: list[int] = field(default_factory=list)
    constants: list[Constant] = field(default_factory=list)
    upvalues: list[Upvalue] = field(default_factory=list)
    protos: list[Prototype] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)  # a line, or a signed delta, for each pc
    anchors: list[tuple[int, int]] = field(default_factory=list)  # (pc, line), 5.4 and 5.5
    locals: list[Local] = field(default_factory=list)
    code_offset: int = 0
    upvalue_names: int = 0


@dataclass
class Chunk:
    profile: str
    main: Prototype
    header_bytes: int = 0
    int_size: int = 4
    size_size: int = 8
    number_size: int = 8
    integral: int = 0
    upvalues: int = 0
    trailing: bytes = b""


@dataclass(frozen=True)
class Layout:
    """What tells a dialect's body from the others'."""

    version: int
    #: Sections after the code, in order.
    sections: tuple[str, ...]
    #: Where the source name stands: first, or in the debug part.
    source_first: bool
    count: str  # i32, varint (last byte marked) or varint55 (others marked)
    tags: dict[int, str]
    delta_lines: bool = False
    aligned: bool = False


# Fixed constant tags and orders of the formats.
LAYOUTS = {
    "5.1": Layout(0x51, ("constants", "protos", "lines", "locals", "names"), True, "i32", {0: "nil", 1: "boolean", 3: "number", 4: "short-string", 9: "integer"}),
    "5.2": Layout(0x52, ("constants", "protos", "upvalues", "source", "lines", "locals", "names"), False, "i32", {0: "nil", 1: "boolean", 3: "float", 4: "short-string"}),
    "5.3": Layout(0x53, ("constants", "upvalues", "protos", "lines", "locals", "names"), True, "i32", {0: "nil", 1: "boolean", 3: "float", 0x13: "integer", 4: "short-string", 0x14: "long-string"}),
    "5.4": Layout(0x54, ("constants", "upvalues", "protos", "lines", "anchors", "locals", "names"), True, "varint", {0: "nil", 1: "false", 0x11: "true", 3: "integer", 0x13: "float", 4: "short-string", 0x14: "long-string"}, True),
    "5.5": Layout(0x55, ("constants", "upvalues", "protos", "source", "lines", "anchors", "locals", "names"), False, "varint55", {0: "nil", 1: "false", 0x11: "true", 3: "zigzag", 0x13: "float", 4: "short-string", 0x14: "long-string"}, True, True),
}


def dialect_of(profile: str) -> str:
    return profile.removeprefix("lua").split("-")[0]


def detect(content: bytes) -> str | None:
    """The profile that a chunk's first bytes name; newest dialects first."""
    for d in ("5.5", "5.4", "5.3", "5.2"):
        if content[:5] == SIGNATURE + bytes([LAYOUTS[d].version]):
            return f"lua{d}"
    if content[:5] == SIGNATURE + b"\x51" and len(content) >= 12:
        if content[11] == 4:
            return "lua5.1-lnum32"
        return "lua5.1-stock32" if content[8] == 4 else "lua5.1"
    return None


class Reader:
    def __init__(self, content: bytes):
        self.raw, self.at, self.words, self.protos = content, 0, 0, 0
        self.reused: list[bytes] = []

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ChunkError("CORE-TRUNC-001", f"{n} bytes wanted, {len(self.raw) - self.at} left", self.at)
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def sized(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def varint(self, last_marked: bool) -> int:
        value = 0
        while True:
            b = self.take(1)[0]
            if value >> 57:
                raise ChunkError(f"L5{4 if last_marked else 5}-VARINT-001", "a number of more than 64 bits", self.at)
            value = value << 7 | b & 127
            if (b >= 128) == last_marked:
                return value

    def align(self, n: int) -> None:
        self.take(-self.at % n)


# What the header holds after the format byte, by dialect, as (code, size and form, values that are read).
HEADER = {
    "5.2": (("004", "B", (1,)), ("005", "B", (4,)), ("006", "B", (4, 8)), ("007", "B", (4,)), ("008", "B", (8,)), ("009", "B", (0,)), ("010", "6s", (TAIL_52,))),
    "5.3": (("004", "6s", (DATA,)), ("005", "B", (4,)), ("006", "B", (4, 8)), ("007", "B", (4,)), ("008", "B", (8,)), ("009", "B", (8,)), ("010", "q", (0x5678,)), ("011", "d", (370.5,))),
    "5.4": (("004", "6s", (DATA,)), ("005", "B", (4,)), ("006", "B", (8,)), ("007", "B", (8,)), ("008", "q", (0x5678,)), ("009", "d", (370.5,))),
    "5.5": (("004", "6s", (DATA,)), ("005", "B", (4,)), ("006", "i", (-0x5678,)), ("007", "B", (4,)), ("008", "I", (0x12345678,)), ("009", "B", (8,)), ("010", "q", (-0x5678,)), ("011", "B", (8,)), ("012", "d", (-370.5,))),
}


def _decode_header(r: Reader, profile: str) -> Chunk:
    d = dialect_of(profile)
    family = f"L{d.replace('.', '')}-HEADER"
    if r.take(4) != SIGNATURE:
        raise ChunkError(f"{family}-001", "signature", 0)
    if r.take(1)[0] != LAYOUTS[d].version:
        raise ChunkError(f"{family}-002", "version", 4)
    c = Chunk(profile, Prototype())
    form = r.take(1)[0]
    if d == "5.1":
        endian, c.int_size, c.size_size, inst, c.number_size, c.integral = r.take(6)
        if endian != 1 or inst != 4 or c.int_size not in (4, 8) or c.size_size not in (4, 8) or c.number_size not in (4, 8):
            raise ChunkError(f"{family}-003", "byte order or sizes", 6)
    else:
        if form != 0 and d != "5.4":  # only 5.4 goes on with one of its own
            raise ChunkError(f"{family}-003", "format", 5)
        got = []
        for code, kind, known in HEADER[d]:
            at = r.at
            got.append(r.number(kind))
            if got[-1] not in known:
                raise ChunkError(f"{family}-{code}", f"{got[-1]!r}", at)
        if d in ("5.2", "5.3"):
            c.int_size, c.size_size = got[1], got[2]
        if d == "5.2":
            c.number_size, c.integral = got[4], got[5]
    c.header_bytes = r.at
    if d in ("5.3", "5.4", "5.5"):
        c.upvalues = r.take(1)[0]
    return c


class _Body:
    def __init__(self, r: Reader, chunk: Chunk):
        self.r, self.c, self.d = r, chunk, dialect_of(chunk.profile)
        self.layout = LAYOUTS[self.d]

    def code(self, name: str) -> str:
        return f"L{self.d.replace('.', '')}-{name}"

    def count(self, most: int | None = None, name: str = "CODE-001") -> int:
        n = self.r.sized(self.c.int_size, True) if self.layout.count == "i32" else self.r.varint(self.layout.count == "varint")
        if n < 0 or (most is not None and n > most):
            raise ChunkError(self.code(name), f"count {n}", self.r.at)
        return n

    def string(self) -> bytes | None:
        r = self.r
        if self.d in ("5.1", "5.2"):
            n = r.sized(self.c.size_size)
        elif self.d == "5.3":
            n = r.take(1)[0]
            n = r.sized(self.c.size_size) if n == 255 else n
        else:
            n = r.varint(self.layout.count == "varint")
        if self.d == "5.5":
            if n == 0:
                k = r.varint(False)
                if k > len(r.reused):
                    raise ChunkError("L55-STR-001", f"no string {k} to use again", r.at)
                return r.reused[k - 1] if k else None
        if n == 0:
            return None
        if n - 1 > MOST_STRING:
            raise ChunkError(self.code("STR-002" if self.d == "5.5" else "STR-001"), f"string of {n - 1} bytes", r.at)
        s = r.take(n)[:-1] if self.d in ("5.1", "5.2", "5.5") else r.take(n - 1)
        if self.d == "5.5":
            r.reused.append(s)
        return s

    def constant(self) -> Constant:
        r, at = self.r, self.r.at
        tag = r.take(1)[0]
        kind = self.layout.tags.get(tag)
        if kind is None:
            raise ChunkError(self.code("CONST-002" if self.d == "5.4" or (self.d == "5.1" and tag == 9) else "CONST-001"), f"constant tag {tag}", at)
        if kind == "number":
            kind = "integer" if self.c.integral == 1 else "float"
        if kind in ("true", "false"):
            c = Constant("boolean", kind == "true")
        elif kind == "boolean":
            c = Constant("boolean", r.take(1)[0] != 0)
        elif kind == "nil":
            c = Constant("nil")
        elif kind == "integer":
            size = (4 if self.c.profile.endswith("lnum32") else self.c.number_size) if self.d == "5.1" else 8
            raw = r.take(size)
            c = Constant("integer", int.from_bytes(raw, "little", signed=True), raw)
        elif kind == "zigzag":
            x = r.varint(False)
            value = ~(x >> 1) if x & 1 else x >> 1
            c = Constant("integer", value, value.to_bytes(8, "little", signed=True))
        elif kind == "float":
            raw = r.take(self.c.number_size if self.d == "5.1" else 8)
            c = Constant("float", struct.unpack("<d" if len(raw) == 8 else "<f", raw)[0], raw)
        else:
            s = self.string()
            c = Constant("nil") if s is None else Constant(kind, s, s)
        c.offset, c.length = at, r.at - at
        return c

    def prototype(self, depth: int = 0) -> Prototype:
        r, d, p = self.r, self.d, Prototype()
        r.protos += 1
        if depth >= MOST_NESTING:
            raise ChunkError("CORE-LIMIT-001", "nesting", r.at)
        if r.protos > MOST_PROTOTYPES:
            raise ChunkError("CORE-LIMIT-002", "number of prototypes", r.at)
        if self.layout.source_first:
            p.source = self.string()
        p.line_defined, p.last_line_defined = self.count(), self.count()
        n_upvalues = r.take(1)[0] if d == "5.1" else None
        p.numparams, p.is_vararg, p.maxstacksize = r.take(3)
        n = self.count(MOST_WORDS)
        r.words += n
        if r.words > MOST_WORDS_IN_ALL:
            raise ChunkError("CORE-LIMIT-004", "words in all", r.at)
        if self.layout.aligned:
            r.align(4)
        p.code_offset = r.at
        p.code = list(struct.unpack(f"<{n}I", r.take(4 * n)))
        if n_upvalues is not None:
            p.upvalues = [Upvalue() for _ in range(n_upvalues)]
        for section in self.layout.sections:
            getattr(self, f"_{section}")(p, depth)
        if d == "5.1":
            bind(p)
        return p

    def _constants(self, p: Prototype, depth: int) -> None:
        p.constants = [self.constant() for _ in range(self.count(MOST_CONSTANTS, "CONST-002" if self.d == "5.3" else "CONST-001"))]

    def _protos(self, p: Prototype, depth: int) -> None:
        p.protos = [self.prototype(depth + 1) for _ in range(self.count(MOST_PROTOTYPES, "PROTO-001"))]

    def _upvalues(self, p: Prototype, depth: int) -> None:
        size = 3 if self.d in ("5.4", "5.5") else 2
        p.upvalues = [Upvalue(*self.r.take(size)) for _ in range(self.count(MOST_UPVALUES, "UPVAL-001"))]

    def _source(self, p: Prototype, depth: int) -> None:
        p.source = self.string()

    def _lines(self, p: Prototype, depth: int) -> None:
        n = self.count()
        if self.layout.delta_lines:
            p.lines = [b - 256 if b > 127 else b for b in self.r.take(n)]
        else:
            p.lines = [self.r.sized(self.c.int_size, True) for _ in range(min(n, len(self.r.raw)))]

    def _anchors(self, p: Prototype, depth: int) -> None:
        n = self.count()
        if self.layout.aligned and n:
            self.r.align(4)
            p.anchors = [(self.r.number("i"), self.r.number("i")) for _ in range(min(n, len(self.r.raw)))]
        else:
            p.anchors = [(self.count(), self.count()) for _ in range(min(n, len(self.r.raw)))]

    def _locals(self, p: Prototype, depth: int) -> None:
        n = self.count()
        for _ in range(n):
            name = self.string()
            p.locals.append(Local(b"?" if name is None else name, self.count(), self.count()))

    def _names(self, p: Prototype, depth: int) -> None:
        p.upvalue_names = self.count()
        for i in range(p.upvalue_names):
            name = self.string()
            if i < len(p.upvalues):
                p.upvalues[i].name = name


def decode(content: bytes, profile: str | None = None) -> Chunk:
    """A chunk, or ChunkError. Bytes after the main prototype are kept as `trailing`."""
    if len(content) > MOST_BYTES:
        raise ChunkError("CORE-LIMIT-001", f"{len(content)} bytes")
    profile = profile or detect(content)
    if profile is None:
        raise ChunkError("PARSE-UNKNOWN-001", "no known signature")
    r = Reader(content)
    c = _decode_header(r, profile)
    c.main = _Body(r, c).prototype()
    c.trailing = content[r.at :]
    return c


# Physical roles of 5.1 words.

CLOSURE, SETLIST, MOVE, GETUPVAL = 36, 34, 0, 4


def roles(p: Prototype) -> tuple[list[tuple[str, int | None, int | None]], list[tuple[str, int]]]:
    """((role, owner pc, upvalue index) of each word, faults (code, pc)): words that belong to a CLOSURE or SETLIST before them are no instructions."""
    n = len(p.code)
    out: list[tuple[str, int | None, int | None]] = [("instruction", None, None)] * n
    faults = []
    for pc, word in enumerate(p.code):
        if out[pc][0] != "instruction":
            continue
        op = word & 63
        if op == CLOSURE and (word >> 14) < len(p.protos):
            wanted = len(p.protos[word >> 14].upvalues)
            for k in range(wanted):
                if pc + 1 + k < n:
                    out[pc + 1 + k] = ("closure_binding", pc, k)
            if pc + wanted >= n:
                faults.append(("L51-CLOSURE-001", pc))
        elif op == SETLIST and word >> 14 & 511 == 0:
            if pc + 1 < n:
                out[pc + 1] = ("setlist_extra", pc, None)
            else:
                faults.append(("L51-SETLIST-001", pc))
    return out, faults


def bind(p: Prototype) -> None:
    """5.1 keeps where a closure's upvalues come from in the words after it."""
    for pc, (role, owner, k) in enumerate(roles(p)[0]):
        if role == "closure_binding":
            child = p.protos[p.code[owner] >> 14].upvalues[k]
            op = p.code[pc] & 63
            if op in (MOVE, GETUPVAL):
                child.instack, child.idx = int(op == MOVE), p.code[pc] >> 23 & 511


# The inverse.


class _Writer:
    def __init__(self, c: Chunk):
        self.c, self.d, self.out, self.seen = c, dialect_of(c.profile), bytearray(), {}
        self.layout = LAYOUTS[self.d]

    def varint(self, n: int, last_marked: bool) -> None:
        groups = [n & 127]
        while n := n >> 7:
            groups.insert(0, n & 127)
        for i, g in enumerate(groups):
            last = i == len(groups) - 1
            self.out.append(g | (128 if last == last_marked else 0))

    def count(self, n: int) -> None:
        if self.layout.count == "i32":
            self.out += n.to_bytes(self.c.int_size, "little", signed=True)
        else:
            self.varint(n, self.layout.count == "varint")

    def string(self, s: bytes | None) -> None:
        if self.d in ("5.1", "5.2"):
            self.out += (0 if s is None else len(s) + 1).to_bytes(self.c.size_size, "little") + (b"" if s is None else s + b"\0")
        elif self.d == "5.3":
            n = 0 if s is None else len(s) + 1
            self.out += bytes([n]) if n < 255 else b"\xff" + n.to_bytes(self.c.size_size, "little")
            self.out += s or b""
        elif self.d == "5.4":
            self.varint(0 if s is None else len(s) + 1, True)
            self.out += s or b""
        elif s is None or s in self.seen:
            self.varint(0, False)
            self.varint(0 if s is None else self.seen[s], False)
        else:
            self.seen[s] = len(self.seen) + 1
            self.varint(len(s) + 1, False)
            self.out += s + b"\0"

    def constant(self, k: Constant) -> None:
        tags = {v: t for t, v in self.layout.tags.items()}
        if k.ctype == "boolean":
            self.out += bytes([tags["boolean"], int(k.value)]) if "boolean" in tags else bytes([tags["true" if k.value else "false"]])
        elif k.ctype == "nil":
            self.out.append(tags["nil"])
        elif k.ctype == "integer" and "zigzag" in tags:
            self.out.append(tags["zigzag"])
            self.varint(~k.value << 1 | 1 if k.value < 0 else k.value << 1, False)
        elif k.ctype in ("integer", "float"):
            number = "number" in tags and (k.ctype == "float" or self.c.integral == 1)
            self.out.append(tags["number" if number else k.ctype])
            self.out += k.raw
        else:
            self.out.append(tags.get(k.ctype, tags["short-string"]))
            self.string(k.value)

    def prototype(self, p: Prototype) -> None:
        if self.layout.source_first:
            self.string(p.source)
        self.count(p.line_defined)
        self.count(p.last_line_defined)
        if self.d == "5.1":
            self.out.append(len(p.upvalues))
        self.out += bytes([p.numparams, p.is_vararg, p.maxstacksize])
        self.count(len(p.code))
        if self.layout.aligned:
            self.out += bytes(-len(self.out) % 4)
        self.out += struct.pack(f"<{len(p.code)}I", *p.code)
        for section in self.layout.sections:
            if section == "constants":
                self.count(len(p.constants))
                for k in p.constants:
                    self.constant(k)
            elif section == "protos":
                self.count(len(p.protos))
                for q in p.protos:
                    self.prototype(q)
            elif section == "upvalues":
                self.count(len(p.upvalues))
                for u in p.upvalues:
                    self.out += bytes([u.instack, u.idx, u.kind][: 3 if self.d in ("5.4", "5.5") else 2])
            elif section == "source":
                self.string(p.source)
            elif section == "lines":
                self.count(len(p.lines))
                for x in p.lines:
                    self.out += bytes([x & 255]) if self.layout.delta_lines else x.to_bytes(self.c.int_size, "little", signed=True)
            elif section == "anchors":
                self.count(len(p.anchors))
                if self.layout.aligned and p.anchors:
                    self.out += bytes(-len(self.out) % 4)
                for pc, line in p.anchors:
                    if self.layout.aligned:
                        self.out += struct.pack("<ii", pc, line)
                    else:
                        self.count(pc)
                        self.count(line)
            elif section == "locals":
                self.count(len(p.locals))
                for x in p.locals:
                    self.string(x.name)
                    self.count(x.startpc)
                    self.count(x.endpc)
            else:
                self.count(p.upvalue_names)
                for u in p.upvalues[: p.upvalue_names]:
                    self.string(u.name)


def encode(c: Chunk) -> bytes:
    """The bytes of a chunk; decode(encode(c)) has the same facts, and encode(decode(b)) is b for chunks in canonical form."""
    w = _Writer(c)
    d = w.d
    w.out += SIGNATURE + bytes([w.layout.version, 0])
    if d in ("5.1", "5.2"):
        w.out += bytes([1, c.int_size, c.size_size, 4, c.number_size, c.integral if d == "5.1" else 0])
        w.out += TAIL_52 if d == "5.2" else b""
    elif d == "5.3":
        w.out += DATA + struct.pack("<BBBBBqd", 4, c.size_size, 4, 8, 8, 0x5678, 370.5)
    elif d == "5.4":
        w.out += DATA + struct.pack("<BBBqd", 4, 8, 8, 0x5678, 370.5)
    else:
        w.out += DATA + struct.pack("<BiBIBqBd", 4, -0x5678, 4, 0x12345678, 8, -0x5678, 8, -370.5)
    if d in ("5.3", "5.4", "5.5"):
        w.out.append(c.upvalues)
    w.prototype(c.main)
    return bytes(w.out + c.trailing)


def walk(p: Prototype, path: tuple[int, ...] = (0,)):
    """(path, prototype) of a tree, parents first."""
    yield path, p
    for i, q in enumerate(p.protos):
        yield from walk(q, (*path, i))


def line_of(p: Prototype) -> list[int | None]:
    """A line for each pc: as stored, or from deltas with absolute anchors (a delta of -128 stands for an anchor)."""
    anchor, line, out = dict(p.anchors), p.line_defined, []
    for pc, x in enumerate(p.lines):
        line = anchor[pc] if x == -128 and pc in anchor else line + x
        out.append(line)
    return out
