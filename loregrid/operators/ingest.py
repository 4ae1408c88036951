"""Classifying and chunking documents, and reading methods from Java sources."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, stripped
from ..schemas import CHUNK, CHUNK_CHARS, OVERLAP_CHARS, PARAGRAPH_CHARS

# What in a path or text tells a document's type, in order of preference.
EXTENSIONS = {".java": "api", ".py": "api", ".go": "api"}
DIRECTORIES = [("spec", "spec"), ("best_practice", "best_practice"), ("practice", "best_practice"), ("defect", "defect_history"), ("issue", "defect_history"), ("bug", "defect_history"), ("api", "api"), ("sdk", "api")]
NAMES = [("spec_", "spec"), ("_spec", "spec"), ("best_practice", "best_practice"), ("practice", "best_practice"), ("defect", "defect_history"), ("_api_", "api")]
CONTENTS = [
    (r"(?:正例|反例|必须遵守|强制规范|Spec\s*契约|规范契约)", "spec"),
    (r"(?i)#{2,3}\s*(?:API|接口|Endpoints?)", "api"),
    (r"###\s*(?:GET|POST|PUT|DELETE|PATCH)\s+/", "api"),
    (r"(?:最佳实践|Best\s*Practice|最佳做法)", "best_practice"),
    (r"(?:缺陷|Bug|根因|修复方案|故障复盘)", "defect_history"),
]
PREVIEW = 800
# Headings of API sections, of their entries, and REST endpoints.
API_SECTIONS = [r"(?im)^##\s*(?:API|接口|Endpoints?|对外接口|REST\s*API)", r"(?im)^###\s*(?:API|接口|Endpoints?|对外接口|REST\s*API)"]
ENTRY = r"\n(?=###(?!#)|####(?!#))"
TITLE = r"^#{2,4}\s*(.+)"
ENDPOINT = r"(?i)(?:###?\s*)?(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S+)"


def classified(path: Column, content: Column) -> Column:
    """The knowledge type of a document: by extension, then directory, then file name, then content, else document."""
    folder, name = F.lower(F.regexp_replace(F.regexp_extract(path, r"^(.*)/", 1), r"\\", "/")), F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    segments, preview = F.split(folder, "/"), F.left(content, F.lit(PREVIEW))
    tests = [(F.endswith(name, F.lit(e)), t) for e, t in EXTENSIONS.items()]
    tests += [(F.array_contains(segments, d), t) for d, t in DIRECTORIES] + [(F.contains(name, F.lit(n)), t) for n, t in NAMES]
    tests += [(preview.rlike(p), t) for p, t in CONTENTS]
    return F.coalesce(*[F.when(test, kind) for test, kind in tests], F.lit("document"))


def endpoint(text: Column) -> tuple[Column, Column]:
    """(HTTP method, path) of the first endpoint in a text; empty without one."""
    return F.upper(F.regexp_extract(text, ENDPOINT, 1)), F.regexp_extract(text, ENDPOINT, 2)


def api_start(text: Column) -> Column:
    """Where a text's API section starts (from 1), 0 without one."""
    first, second = (F.regexp_instr(text, F.lit(p)) for p in API_SECTIONS)
    return F.when(first > 0, first).otherwise(second)


def api_entries(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with entry_no, entry_title, entry, http_method, url_path: a row for each entry of the API section that has a body below its heading."""
    start = api_start(F.col(text))
    held = docs.withColumn("_part", F.when(start > 0, F.substring(F.col(text), start, F.length(text)))).where("_part IS NOT NULL")
    each = held.select("*", F.posexplode(F.split("_part", ENTRY)).alias("entry_no", "_entry")).withColumn("entry", stripped(F.col("_entry")))
    body = stripped(F.regexp_replace("entry", r"^[^\n]*\n?", ""))
    method, path = endpoint(F.col("entry"))
    return each.where(body != "").withColumns({"entry_title": stripped(F.regexp_extract("entry", TITLE, 1)), "http_method": method, "url_path": path}).drop("_part", "_entry")


def packed_paragraphs(text: Column, separator: str = r"\n\s*\n", most: int = PARAGRAPH_CHARS) -> Column:
    """Paragraphs put together in order until each part has at least so many characters; the last may have fewer."""
    parts = F.filter(F.transform(F.split(text, separator), stripped), lambda p: p != "")
    zero = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        more = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        full = F.length(more) >= most
        return F.struct(F.when(full, F.concat(s["done"], F.array(more))).otherwise(s["done"]).alias("done"), F.when(full, "").otherwise(more).alias("open"))

    return F.aggregate(parts, zero, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents (path, content, type, title, module).

    A text with an API section gives the paragraphs before it as documents and the section's entries as api chunks, numbered on. Other texts are packed
    to some 10,000 characters, each chunk starting with the end of the one before; such a chunk's number is the number of its first new part.
    """
    start = api_start(F.col("content"))
    d = docs.withColumn("_start", start)
    names = ("path", "type", "title", "module")
    before = d.where("_start > 1").select(*names, F.posexplode(packed_paragraphs(F.expr("substring(content, 1, _start - 1)"))).alias("n", "text"))
    count = before.groupBy("path").agg(F.max("n").alias("_n"))
    entries = api_entries(d.where("_start > 0")).join(count, "path", "left")
    ranked = F.row_number().over(_by("path", "entry_no")) + F.coalesce(F.col("_n") + 1, F.lit(0)) - 1
    meta = F.when(F.col("http_method") != "", F.to_json(F.struct(F.lit("doc").alias("knowledge_source"), F.lit("rest").alias("api_type"), "http_method", "url_path"))).otherwise(F.to_json(F.struct(F.lit("doc").alias("knowledge_source"))))
    doc_meta = F.to_json(F.struct(F.lit("doc").alias("knowledge_source")))
    a = before.select("path", F.lit("document").alias("type"), "title", "module", "n", "text", doc_meta.alias("meta_json"))
    b = entries.select("path", F.lit("api").alias("type"), F.when(F.col("entry_title") != "", F.col("entry_title")).otherwise(F.col("title")).alias("title"), "module", ranked.alias("n"), F.col("entry").alias("text"), meta.alias("meta_json"))
    zero = F.expr("named_struct('done', CAST(array() AS array<struct<n: int, text: string>>), 'open', '', 'n', 0)")

    def add(s: Column, p: Column) -> Column:
        more = F.when(s["open"] == "", p["text"]).otherwise(F.concat(s["open"], F.lit("\n\n"), p["text"]))
        over = (s["open"] != "") & (F.length(more) > CHUNK_CHARS)
        tail = F.when(F.length(s["open"]) > OVERLAP_CHARS, F.right(s["open"], F.lit(OVERLAP_CHARS))).otherwise("")
        return F.struct(
            F.when(over, F.concat(s["done"], F.array(F.struct(s["n"].alias("n"), s["open"].alias("text"))))).otherwise(s["done"]).alias("done"),
            F.when(over, F.concat(tail, F.lit("\n\n"), p["text"])).otherwise(more).alias("open"),
            F.when(over, p["i"]).otherwise(s["n"]).alias("n"),
        )

    numbered = F.transform(packed_paragraphs(F.col("content")), lambda t, i: F.struct(i.alias("i"), t.alias("text")))
    whole = F.aggregate(numbered, zero, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["n"].alias("n"), s["open"].alias("text"))))))
    c = d.where("_start = 0").select(*names, F.explode(whole).alias("c")).select(*names, "c.n", "c.text", doc_meta.alias("meta_json"))
    rows = a.unionByName(b).unionByName(c)
    return rows.select(
        chunk_id(F.col("path"), F.col("n").cast("string")).alias("id"), "type", F.col("text").alias("content"), "title", "module", F.col("path").alias("source_path"),
        (F.length("text") / 2).cast("int").alias("tokens"), "meta_json", F.col("n").alias("ord"))


def _by(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)


# ---------------------------------------------------------------- Java

_JAVA = re.compile(r'(?P<doc>/\*\*.*?\*/)|(?P<note>/\*.*?\*/|//[^\n]*)|(?P<text>"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>[^\s])', re.S)
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "transient", "volatile", "sealed"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized", "throw", "assert", "do", "else", "try"}


def _signs(source: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[m.lastgroup]) for m in _JAVA.finditer(source) if m.lastgroup != "note"]


def _joined(parts: list[str]) -> str:
    """Type tokens as written, without spaces but after commas and between words."""
    out = ""
    for p in parts:
        out += (" " if out and (out[-1] == "," or (out[-1].isalnum() and p[0].isalnum())) else "") + p
    return out


def public_members(source: str) -> Iterator[dict]:
    """Public methods and constructors of classes: class_name, name, return_type, parameters, calls, doc (the comment right before), overload."""
    signs, package, scopes, doc, at = _signs(source), "", [], "", 0
    depth, seen = 0, {}

    def closing(i: int, opener: str, closer: str) -> int:
        level = 0
        while i < len(signs):
            level += (signs[i] == ("sign", opener)) - (signs[i] == ("sign", closer))
            if level == 0:
                return i
            i += 1
        return i

    head: list[tuple[str, str]] = []
    while at < len(signs):
        kind, value = signs[at]
        if kind == "doc":
            doc, head = value, []
        elif (kind, value) == ("sign", "@") and at + 1 < len(signs) and signs[at + 1][1] != "interface":
            at += 1
            while at + 2 < len(signs) and signs[at + 1] == ("sign", "."):
                at += 2
            if at + 1 < len(signs) and signs[at + 1] == ("sign", "("):
                at = closing(at + 1, "(", ")")
        elif (kind, value) == ("sign", ";"):
            if head and head[0][1] == "package":
                package = "".join(v for _, v in head[1:])
            if head:
                doc = ""
            head = []
        elif (kind, value) == ("sign", "("):
            end = closing(at, "(", ")")
            inside = scopes and scopes[-1][1] == depth
            names = [v for _, v in head]
            after = end + 1
            while after < len(signs) and signs[after][1] not in ("{", ";", "="):
                after += 1
            if inside and head and head[-1][0] == "word" and "=" not in names:
                body_end = closing(after, "{", "}") if after < len(signs) and signs[after][1] == "{" else after
                words = [v for v in names[:-1] if v not in _MODIFIERS]
                if words[:1] == ["<"]:  # a method's own type parameters are no part of what it returns
                    level = 0
                    for i, v in enumerate(words):
                        level += (v == "<") - (v == ">")
                        if level == 0:
                            words = words[i + 1 :]
                            break
                name, owner = names[-1], ".".join([*filter(None, [package]), *(s for s, _ in scopes)])
                made = name == scopes[-1][0] and not words
                if "public" in names and (words or made):
                    params, part, level = [], [], 0
                    for k, v in [*signs[at + 1 : end], ("sign", ",")]:
                        level += (v == "<") - (v == ">")
                        if v == "," and level == 0:
                            part = [x for x in part if x not in _MODIFIERS]
                            if part:
                                params.append(f"{_joined(part[:-1])} {part[-1]}")
                            part = []
                        elif k in ("word", "sign") and v != "@":
                            part.append(v)
                    inner = signs[after:body_end]
                    calls = [inner[i][1] for i in range(len(inner) - 1) if inner[i][0] == "word" and inner[i + 1] == ("sign", "(") and inner[i][1] not in _NOT_CALLS and (i == 0 or inner[i - 1] != ("word", "new"))]
                    key = (owner, name)
                    seen[key] = seen.get(key, -1) + 1
                    yield {"class_name": owner, "simple": scopes[-1][0], "name": name, "made": made, "return_type": _joined(words), "parameters": ", ".join(params), "calls": [] if made else calls, "doc": _comment(doc), "overload": seen[key]}
                at, head, doc = body_end, [], ""
            else:
                head += signs[at : end + 1]
                at = end
        elif (kind, value) == ("sign", "{"):
            names = [v for _, v in head]
            which = next((k for k in ("class", "record", "interface", "enum") if k in names), None)
            if which and names.index(which) + 1 < len(names):
                scopes.append((names[names.index(which) + 1], depth + 1))
            depth += 1
            head, doc = [], ""
        elif (kind, value) == ("sign", "}"):
            if scopes and scopes[-1][1] == depth:
                scopes.pop()
            depth -= 1
            head, doc = [], ""
        else:
            head.append((kind, value))
        at += 1


def _comment(text: str) -> str:
    lines = [re.sub(r"^\s*\*?\s?", "", x).strip() for x in text.removeprefix("/**").removesuffix("*/").split("\n")]
    return "\n".join(x for x in lines if x)


def java_chunks(source: str, path: str, sdk: str, version: str) -> list[tuple]:
    """Rows of CHUNK for a source file's public members. Overloads share an id, as ids are made of the member's name alone."""
    out = []
    for m in public_members(source):
        name = "constructor" if m["made"] else m["name"]
        head = f"public {m['name']}({m['parameters']})" if m["made"] else f"public {m['return_type']} {m['name']}({m['parameters']})"
        meta = {"knowledge_source": "sdk_code", "sdk": sdk, "version": version, "class_name": m["class_name"], "method": name, "return_type": m["return_type"], "calls": m["calls"]}
        key = hashlib.md5(f"{sdk}:{m['class_name']}.{name}".encode() if not m["made"] else f"{sdk}:{m['class_name']}:constructor".encode()).hexdigest()[:12]
        text = head + ("\n" + m["doc"] if m["doc"] else "")
        out.append((key, "api", text, f"{m['simple']}.{name}", sdk, path, len(text) // 2, json.dumps(meta, ensure_ascii=False)))
    return out


def java_methods(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Chunks of Java files (path, content), each counted to the deepest module (pom_dir, artifact_id, resolved) that holds it."""
    near = (F.col("pom_dir") == "") | F.startswith(F.col("path"), F.concat("pom_dir", F.lit("/")))
    held = files.where(F.endswith("path", F.lit(".java"))).join(F.broadcast(modules), near, "left")
    own = held.groupBy("path").agg(F.max_by(F.struct("artifact_id", "resolved", "content"), F.coalesce(F.length("pom_dir"), F.lit(-1))).alias("o"))
    rows = own.select("path", "o.content", F.coalesce("o.artifact_id", F.lit("")).alias("sdk"), F.coalesce("o.resolved", F.lit("")).alias("version"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [r for p, c, s, v in zip(pdf["path"], pdf["content"], pdf["sdk"], pdf["version"]) for r in java_chunks(c, p, s, v)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    return rows.mapInPandas(run, CHUNK)
