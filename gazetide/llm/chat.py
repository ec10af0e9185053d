"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON text of any layout, or a variant of one. The names of its nested fields, hashed, are its
fingerprint; a small table of declarative mappings says for each known fingerprint where the
turns are. Mapped records become canonical turns, an array of (role, text), and those become one
formatted text with a loss mask over what the assistant says.

The template marks a turn as ``<|turn ROLE|>TEXT<|end|>``. Control strings, its own and those of
other common templates, are broken by a backslash after their first character where roles or
texts hold them, and backslashes are doubled; ``read_back`` undoes both.

Defined results: a null text is empty, a null role too. Records whose fingerprint is unknown or
that are no JSON keep a null ``layout`` and null turns; so do records whose list is empty; with
``strict`` they stop the job instead. JSON texts above the parser's 20 million characters are no
JSON to it; rows of a table never become JSON, so only a variant's 128 MiB a conversation bound
them, beyond which the job stops. Roles keep their names but for ``ROLES``. Rows of one conversation are ordered by turn,
then role and text, so ties and repeated rows have one order. Rows with a null id are one
conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

# name, list path or "", then (role, path) pairs; in a list: the paths of role and text.
MAPPINGS = (
    ("role-content", "messages", (("role", "content"),)),
    ("role-text", "messages", (("role", "text"),)),
    ("from-value", "conversations", (("from", "value"),)),
    ("turns", "turns", (("speaker", "text"),)),
    ("prompt-response", "", (("user", "prompt"), ("assistant", "response"))),
    ("prompt-completion", "", (("user", "prompt"), ("assistant", "completion"))),
    ("question-answer", "", (("user", "question"), ("assistant", "answer"))),
    ("instruction-output", "", (("user", "instruction"), ("assistant", "output"))),
    ("instruction-input-output", "", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    ("system-prompt-response", "", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BREAK = r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=/?INST\]))"
TURNS = "array<struct<role:string,text:string>>"


def layout_of(mapping: tuple) -> str:
    """The canonical nested names of a mapping, as ``field_names`` gives them."""
    _, path, fields = mapping
    if path:
        return f"{{{path}:[{{{','.join(sorted(fields[0]))}}}]}}"
    return "{" + ",".join(sorted(name for _, name in fields)) + "}"


def field_names(record: Column) -> Column:
    """The nested field names of a variant, without types, in order."""
    shape = F.schema_of_variant(record)
    for pattern, into in (
        (r"OBJECT<", "{"),
        (r"ARRAY<", "["),
        (r": (STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DECIMAL\([0-9, ]+\))", ""),
        (r", ", ","),
        (r": ", ":"),
    ):
        shape = F.regexp_replace(shape, pattern, into)
    # Closing brackets by their partner: lists hold objects in every known layout.
    return F.replace(F.regexp_replace(shape, r">>>$", "}]}"), F.lit(">"), F.lit("}"))


def fingerprint(names: Column) -> Column:
    return F.xxhash64(names)


def mapping_table(spark: SparkSession) -> DataFrame:
    """fingerprint, layout: one row per mapping."""
    rows = ",".join(f"('{layout_of(m)}', '{m[0]}')" for m in MAPPINGS)
    return spark.sql(f"SELECT names, layout FROM VALUES {rows} AS t(names, layout)").select(
        fingerprint(F.col("names")).alias("fingerprint"), "layout"
    )


def _clean_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for name, canonical in ROLES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _turns(record: Column, mapping: tuple) -> Column:
    _, path, fields = mapping
    text = lambda v, p: F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.lit(""))
    if path:
        role, value = fields[0]
        rows = F.try_variant_get(record, f"$.{path}", "array<variant>")
        return F.transform(rows, lambda v: F.struct(_clean_role(F.try_variant_get(v, f"$.{role}", "string")).alias("role"), text(v, value).alias("text")))
    return F.array(*(F.struct(F.lit(role).alias("role"), text(record, name).alias("text")) for role, name in fields))


def canonical(records: DataFrame, strict: bool = False) -> DataFrame:
    """``records`` (any columns, ``record`` as JSON text or variant) with ``fingerprint``,
    ``layout``, ``turns``. The mapping table has one row per mapping; a join with it is broadcast
    by size."""
    is_variant = isinstance(records.schema["record"].dataType, VariantType)
    parsed = records.withColumn("__v", F.col("record") if is_variant else F.try_parse_json("record"))
    marked = parsed.withColumn("fingerprint", fingerprint(field_names(F.col("__v"))))
    joined = marked.join(mapping_table(records.sparkSession), "fingerprint", "left")
    turns = F.lit(None).cast(TURNS)
    for mapping in reversed(MAPPINGS):
        turns = F.when(F.col("layout") == mapping[0], _turns(F.col("__v"), mapping)).otherwise(turns)
    turns = turns.cast(TURNS)
    if strict:
        turns = F.coalesce(turns, F.raise_error(F.lit("a record has no known layout")).cast(TURNS))
    return joined.withColumn("turns", turns).drop("__v")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """With ``formatted`` and ``loss_mask``: the lengths of stretches of ``formatted``, by turns
    outside and inside the loss."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|turn "), escaped(t["role"]), F.lit("|>")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    with_parts = turns.withColumn("__parts", parts)
    return with_parts.withColumn(
        "formatted",
        F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>"))), ""),
    ).withColumn(
        "loss_mask",
        F.transform(
            "__parts",
            lambda p: F.struct(
                F.length(p["head"]).alias("before"), F.length(p["body"]).alias("body"), p["loss"].alias("loss"),
                F.lit(len("<|end|>")).alias("after"),
            ),
        ),
    ).drop("__parts")


def read_back(texts: DataFrame) -> DataFrame:
    """With ``read_turns`` from ``formatted`` alone, and ``loss_text``: what lies under the mask,
    unescaped and laid end to end."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    read = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len("<|turn ") + 1)), "|>", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, "|>") + 2)).alias("text"),
        ),
    )
    # The mask walks over the marked pieces: head, body, end.
    body = F.transform(pieces, lambda p, i: F.substr(p, F.get("loss_mask", i)["before"] + 1, F.get("loss_mask", i)["body"]))
    loss = F.filter(
        F.arrays_zip(body.alias("text"), F.transform("loss_mask", lambda m: m["loss"]).alias("loss")), lambda x: x["loss"]
    )
    return texts.withColumn("read_turns", read).withColumn(
        "loss_text", F.array_join(F.transform(loss, lambda x: unescaped(x["text"])), "")
    )


# The layouts in which a role may have any name.
NAMED_ROLES = [m for m in MAPPINGS if m[1]]


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: one variant for each conversation, in one of ``NAMED_ROLES``, which the
    hash of its id picks."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    record = F.lit(None).cast("variant")
    for i, (_, path, ((role, text),)) in enumerate(NAMED_ROLES):
        messages = F.transform("rows", lambda r: F.struct(r["role"].alias(role), r["text"].alias(text)))  # noqa: B023
        shaped = F.to_variant_object(F.struct(messages.alias(path)))
        picked = F.pmod(F.xxhash64("conv_id"), F.lit(len(NAMED_ROLES))) == i
        record = F.when(picked, shaped).otherwise(record)
    return grouped.select("conv_id", record.alias("record"))


def digest(texts: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return texts.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
