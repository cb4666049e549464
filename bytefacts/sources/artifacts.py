"""Artifacts as a Spark source: bounded reads of files, input lists, classification, and fact frames from one pass of the decoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bytefacts.functions import ids, scalar
from bytefacts.sources import chunks

SIGNATURE_HEX = "1b4c7561"


def artifacts(spark: SparkSession, paths: str | list[str], most: int = chunks.MOST_BYTES) -> DataFrame:
    """path, content, sha256, byte_length, status: ok or limit. Files beyond `most` bytes keep a row but no content."""
    files = spark.read.format("binaryFile").load(paths)
    small = F.col("length") <= most
    content = F.when(small, F.col("content"))
    return files.select("path", content.alias("content"), F.sha2(content, 256).alias("sha256"), F.col("length").alias("byte_length"), F.when(small, "ok").otherwise("limit").alias("status"))


def input_list(spark: SparkSession, text: str, most: int = 100_000) -> DataFrame:
    """(ord, path) of a list with one path a line: trimmed, blank lines skipped, order and repeats kept."""
    names = [x.strip() for x in text.splitlines() if x.strip()]
    if len(names) > most:
        raise ValueError(f"more than {most} inputs")
    return spark.createDataFrame(list(enumerate(names)), "ord int, path string")


def listed(spark: SparkSession, text: str) -> DataFrame:
    """The artifacts of an input list in its order; a path that can't be read has status missing."""
    names = input_list(spark, text)
    known = [r.path for r in names.select("path").distinct().collect()]
    here = [p for p in known if _exists(spark, p)]
    if not here:
        return names.select("ord", "path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("byte_length"), F.lit("missing").alias("status"))
    found = artifacts(spark, here).withColumn("name", F.regexp_replace("path", "^file:/*", "/")).drop("path")
    return names.join(found, F.regexp_replace(names.path, "^file:/*", "/") == found.name, "left").select("ord", "path", "content", "sha256", "byte_length", F.coalesce("status", F.lit("missing")).alias("status"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def profile(content: Column) -> Column:
    """The profile that a chunk's first bytes name, or null."""
    head = F.lower(F.hex(F.substring(content, 1, 5)))
    byte = lambda n: F.conv(F.hex(F.substring(content, n, 1)), 16, 10).cast("int")
    out = F.when((head == SIGNATURE_HEX + "51") & (F.octet_length(content) >= 12), F.when(byte(12) == 4, "lua5.1-lnum32").when(byte(9) == 4, "lua5.1-stock32").otherwise("lua5.1"))
    for d in ("5.2", "5.3", "5.4", "5.5"):
        out = out.when(head == f"{SIGNATURE_HEX}{chunks.LAYOUTS[d].version:02x}", f"lua{d}")
    return out


def skip_code(content: Column) -> Column:
    """Why a file is no chunk: source text (begins with -- or is ASCII at first), an unknown kind, or a damaged chunk; null for a known profile."""
    starts = F.lower(F.hex(F.substring(content, 1, 4)))
    head = F.hex(F.substring(content, 1, 256))
    ascii_ = ~F.regexp_replace(head, "(..)", "$1 ").rlike("(?:^| )[89A-F][0-9A-F] ")
    signed = starts == SIGNATURE_HEX
    return F.when(profile(content).isNotNull(), None).when(~signed & (starts.startswith("2d2d") | (ascii_ & (F.octet_length(content) > 0))), "PARSE-SOURCE-001").when(~signed, "PARSE-UNKNOWN-001").otherwise("PARSE-001")


ROWS = (
    "path string, sha256 string, byte_length long, profile string, kind string, proto array<int>, idx int, byte_offset long, length int, word long, role string, owner_pc int, upvalue_index int, ctype string, bool_val boolean, "
    "int_val long, dbl_val double, raw_hex string, str_raw binary, instack int, upidx int, upkind int, name binary, startpc int, endpc int, line long, line_defined long, last_line_defined long, numparams int, is_vararg int, "
    "maxstacksize int, n_instr int, n_const int, n_upval int, n_protos int, code string, message string"
)


def chunk_rows(content: bytes, profile_: str | None = None) -> list[dict]:
    """The rows of one artifact, by kind; a chunk that can't be read has one row of kind diagnostic and one of kind chunk."""
    try:
        c = chunks.decode(content, profile_)
    except chunks.ChunkError as e:
        return [{"kind": "diagnostic", "code": e.code, "message": e.message, "byte_offset": e.offset}, {"kind": "chunk", "profile": profile_ or chunks.detect(content), "code": "failed"}]
    out: list[dict] = [{"kind": "chunk", "profile": c.profile, "code": "decoded", "str_raw": c.trailing, "raw_hex": content[: c.header_bytes].hex()}]
    old = c.profile.startswith("lua5.1")
    for path, p in chunks.walk(c.main):
        at = {"proto": list(path)}
        out.append(at | {"kind": "prototype", "idx": path[-1], "name": p.source, "line_defined": p.line_defined, "last_line_defined": p.last_line_defined, "numparams": p.numparams, "is_vararg": p.is_vararg, "maxstacksize": p.maxstacksize, "n_instr": len(p.code), "n_const": len(p.constants), "n_upval": len(p.upvalues), "n_protos": len(p.protos)})
        physical, faults = chunks.roles(p) if old else ([("instruction", None, None)] * len(p.code), [])
        lines = chunks.line_of(p) if chunks.LAYOUTS[chunks.dialect_of(c.profile)].delta_lines else p.lines
        for pc, word in enumerate(p.code):
            role, owner, upvalue = physical[pc]
            out.append(at | {"kind": "word", "idx": pc, "word": word, "byte_offset": p.code_offset + 4 * pc, "length": 4, "role": role, "owner_pc": owner, "upvalue_index": upvalue, "line": lines[pc] if pc < len(lines) else None})
        out += [at | {"kind": "diagnostic", "idx": pc, "code": code, "message": "words of an instruction are missing"} for code, pc in faults]
        for i, k in enumerate(p.constants):
            typed = {"boolean": "bool_val", "integer": "int_val", "float": "dbl_val"}.get(k.ctype)
            text = k.ctype.endswith("string")
            out.append(at | {"kind": "constant", "idx": i, "ctype": k.ctype, "byte_offset": k.offset, "length": k.length, "raw_hex": None if text or not k.raw else k.raw.hex(), "str_raw": k.raw if text else None} | ({typed: k.value} if typed else {}))
        out += [at | {"kind": "upvalue", "idx": i, "instack": u.instack, "upidx": u.idx, "upkind": u.kind, "name": u.name} for i, u in enumerate(p.upvalues)]
        out += [at | {"kind": "local", "idx": i, "name": x.name, "startpc": x.startpc, "endpc": x.endpc} for i, x in enumerate(p.locals)]
    return out


def decoded(found: DataFrame, override: str | None = None) -> DataFrame:
    """All rows (ROWS) of artifacts (path, content), in one pass of the decoder: an artifact in, its rows out in batches."""
    schema = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                who = {"path": path, "sha256": hashlib.sha256(content).hexdigest(), "byte_length": len(content)}
                rows = chunk_rows(content, override)
                known = rows[0].get("profile") or chunks.detect(content)
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_pylist([{"profile": known} | who | r for r in rows[at : at + 20_000]], schema=schema)

    return found.select("path", "content").mapInArrow(run, ROWS)


@dataclass
class Facts:
    chunks: DataFrame
    prototypes: DataFrame
    words: DataFrame
    constants: DataFrame
    upvalues: DataFrame
    locals: DataFrame
    diagnostics: DataFrame


WHO = ("path", "sha256", "profile")


def _bits() -> Column:
    """Bits of an eight-byte float, most significant first; its raw bytes are little-endian. Null for others."""
    pairs = F.reverse(F.regexp_extract_all("raw_hex", F.lit(".."), F.lit(0)))
    return F.when((F.col("ctype") == "float") & (F.length("raw_hex") == 16), F.array_join(pairs, ""))


def facts(rows: DataFrame) -> Facts:
    """Fact frames as narrow selections of the decoder's rows; write or cache `rows` first if several are used."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    index = F.col("idx").alias("index")
    return Facts(
        of("chunk").select(*WHO, "byte_length", F.col("code").alias("status"), F.hex("str_raw").alias("trailing_hex"), F.col("raw_hex").alias("header_hex")),
        of("prototype").select(*WHO, "proto", ids.proto_text(F.col("proto")).alias("id"), F.slice("proto", 1, F.size("proto") - 1).alias("parent"), F.col("idx").alias("child_index"), F.col("name").alias("source_name"), "line_defined", "last_line_defined", "numparams", "is_vararg", "maxstacksize", "n_instr", "n_const", "n_upval", "n_protos"),
        of("word").select(*WHO, "proto", F.col("idx").alias("pc"), ids.text(F.col("proto"), "pc", F.col("idx")).alias("id"), F.col("word").alias("raw_word"), "byte_offset", F.col("length").alias("byte_length"), "role", "owner_pc", "upvalue_index", "line"),
        of("constant").select(*WHO, "proto", index, ids.text(F.col("proto"), "constant", F.col("idx")).alias("id"), "ctype", "bool_val", "int_val", "dbl_val", _bits().alias("dbl_bits"), "raw_hex", "str_raw", scalar.escape(F.col("str_raw")).alias("str_display"), F.isnan("dbl_val").alias("is_nan")),
        of("upvalue").select(*WHO, "proto", index, ids.text(F.col("proto"), "upvalue", F.col("idx")).alias("id"), "instack", F.col("upidx").alias("idx"), F.col("upkind").alias("kind"), "name"),
        of("local").select(*WHO, "proto", index, ids.text(F.col("proto"), "local", F.col("idx")).alias("id"), "name", "startpc", "endpc"),
        of("diagnostic").select(*WHO, "code", F.lit("error").alias("severity"), ids.proto_text(F.col("proto")).alias("target"), F.col("idx").alias("pc"), "message", "byte_offset"),
    )
