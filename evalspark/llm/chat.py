"""Chat formatting by schema fingerprints.

A record is a JSON text in any of several layouts.  Its nested field paths, without
types and restricted to the paths that layouts speak about, are hashed; the hash
selects a declarative mapping (expressions over the parsed record) that yields
canonical turns ``(role, text)``.  A template then marks turns, and escapes its own
control characters inside texts so that the result can be read back exactly:
backslash, ``<`` and ``#`` (``:`` too in roles) become two-character escapes, so
neither the turn head ``### `` nor the turn end ``</turn>`` can occur in a text.

Defined cases: null or unparseable records and unknown fingerprints have no turns,
``layout`` null and ``problem`` says why; null texts are empty; a null role is ``user``; fields that no layout
names are ignored; an empty list of messages has no turns and a zero-length format.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"

_MESSAGE = "array<struct<role:string,content:string>>"
_SHARE = "array<struct<`from`:string,value:string>>"
#: names of the roles in the layout of shared conversations (fixed values); other layouts name roles as they are
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _fixed(*pairs):
    """Turns from single fields: (role, path, optional); optional ones go when empty."""
    def turns(rec: Column) -> Column:
        each = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(_text(rec, path), F.lit("")).alias("text"),
                                  F.lit(opt).alias("opt")) for role, path, opt in pairs])
        return F.transform(F.filter(each, lambda t: ~t["opt"] | (t["text"] != "")),
                           lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns


def _text(rec: Column, path: str) -> Column:
    return F.try_variant_get(rec, f"$.{path}", "string")


def _list(path: str, kind: str, role: str, text: str, aliases: dict | None = None):
    def turns(rec: Column) -> Column:
        names = F.create_map(*[F.lit(x) for kv in (aliases or {}).items() for x in kv]) if aliases else None
        own = (lambda r: F.coalesce(F.try_element_at(names, r), r, F.lit("user"))) if aliases else (lambda r: F.coalesce(r, F.lit("user")))
        return F.transform(F.try_variant_get(rec, f"$.{path}", kind), lambda t: F.struct(
            own(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    return turns


#: layout -> (field paths, mapping); a path ``a[].b`` is field b of the objects in list a
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), _list("messages", _MESSAGE, "role", "content")),
    "share": (("conversations[].from", "conversations[].value"), _list("conversations", _SHARE, "from", "value", ROLES)),
    "prompt_response": (("prompt", "response"), _fixed(("user", "prompt", False), ("assistant", "response", False))),
    "prompt_completion": (("prompt", "completion"), _fixed(("user", "prompt", False), ("assistant", "completion", False))),
    "instruction": (("instruction", "output"), _fixed(("user", "instruction", False), ("assistant", "output", False))),
    "instruction_input": (("instruction", "input", "output"),
                          _fixed(("user", "instruction", False), ("user", "input", True), ("assistant", "output", False))),
    "system_prompt": (("prompt", "response", "system"),
                      _fixed(("system", "system", True), ("user", "prompt", False), ("assistant", "response", False))),
}
PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(rec: Column) -> Column:
    """Hash of the known field paths that occur in a parsed record."""
    def there(p: str) -> Column:
        if "[]." not in p:
            return F.is_variant_null(rec).__invert__() & F.try_variant_get(rec, f"$.{p}", "variant").isNotNull()
        head, leaf = p.split("[].")
        items = F.try_variant_get(rec, f"$.{head}", "array<variant>")
        return F.coalesce(F.exists(items, lambda v: F.try_variant_get(v, f"$.{leaf}", "variant").isNotNull()), F.lit(False))
    found = F.filter(F.array(*[F.when(there(p), F.lit(p)) for p in PATHS]), lambda x: x.isNotNull())
    return F.sha2(F.array_join(found, "\n"), 256)


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`: backslash pairs are taken from the left of a run."""
    pieces = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(F.replace(
        x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":")))
    return F.array_join(pieces, "\\")


def to_turns(df: DataFrame, record: str = "record", strict: bool = False) -> DataFrame:
    """Add ``layout``, canonical ``turns`` and ``problem`` to rows with a JSON text: why a row has
    no layout (``null``, ``unparsed``: no JSON, or more than Spark's variants hold (128 MiB),
    or ``unknown layout``).  With ``strict`` the turns of such a row are an error, so that no text
    can go unseen."""
    parsed = df.withColumn("__rec", F.try_parse_json(F.col(record))).withColumn("__fp", fingerprint(F.col("__rec")))
    kind = "array<struct<role:string,text:string>>"
    layout = F.lit(None).cast("string")
    turns = F.raise_error(F.lit("a chat record has no known layout")).cast(kind) if strict else F.lit(None).cast(kind)
    for name, (paths, mapping) in LAYOUTS.items():
        hit = F.col("__fp") == fingerprint_of(paths)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, mapping(F.col("__rec"))).otherwise(turns)
    none = F.array().cast(kind)
    problem = (F.when(F.col(record).isNull(), "null").when(F.col("__rec").isNull(), "unparsed")
               .when(layout.isNull(), "unknown layout"))
    return parsed.withColumns({"layout": layout, "turns": F.coalesce(turns, none), "problem": problem}).drop("__rec", "__fp")


def format_chat(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask`` (spans, start inclusive, end exclusive, in code
    points) to rows with canonical ``turns``."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(MID)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + len(TAIL)).cast("bigint").alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return (df.withColumn("__parts", parts)
            .withColumn("formatted", F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), ""))
            .withColumn("loss_mask", F.aggregate("__parts", start, step)["spans"]).drop("__parts"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    whole = F.split(formatted, r"</turn>\n", -1)
    return F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), lambda s: F.struct(
        unescape(F.regexp_extract(s, r"^### ([^:]*): ", 1)).alias("role"),
        unescape(F.regexp_replace(s, r"^### [^:]*: ", "")).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """Unescaped text under the loss mask, nothing between the spans."""
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
