"""Prompt construction by concatenating template segments and columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.binding import let
from askgrid.sources.templates import PROMPT_KINDS, template_table

Templates = dict[str, dict[str, str]]

# The prompt kinds a training prompt may have on each route, and the
# fields each kind fills in. The generic route never shows the table.
TRAINING_KINDS = {
    "generic": ["full_prompt", "input_prompt", "data_prompt", "default_prompt"],
    "script": ["full_prompt", "data_prompt"],
    "arithmetic": ["full_prompt", "data_prompt"],
    "table": ["full_prompt", "input_prompt", "data_prompt"],
    "template": ["full_prompt", "input_prompt", "data_prompt", "default_prompt"],
}
KIND_FIELDS = {
    "full_prompt": ["instruction", "input", "data"],
    "input_prompt": ["instruction", "input"],
    "data_prompt": ["instruction", "data"],
    "default_prompt": ["instruction"],
}
GENERIC_FIELDS = {
    "full_prompt": ["instruction"],
    "input_prompt": ["instruction", "input"],
    "data_prompt": ["instruction"],
    "default_prompt": ["instruction"],
}
TOOL_TARGETS = {"script": "derivation_sql", "arithmetic": "derivation_eval"}

NOW_ANSWER = "Now answer the following:\n\n"
ANSWER_MARK = "###Answer"


def present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def prompt_kind() -> Column:
    """Which prompt a row gets, by which of its fields hold text."""
    return (
        F.when(present("input") & present("data"), F.lit("full_prompt"))
        .when(present("data"), F.lit("data_prompt"))
        .when(present("input"), F.lit("input_prompt"))
        .otherwise(F.lit("default_prompt"))
    )


def segments(text: str) -> list[tuple[str, str | None]]:
    """Split a template into ``(literal, field)`` pairs."""
    return [(literal, field) for literal, field, _, _ in Formatter().parse(text)]


def fillable(text: str, allowed: list[str]) -> list[tuple[str, str | None]] | None:
    """The segments of a template; None if it asks for a field it may not use."""
    parts = segments(text)
    return parts if all(field is None or field in allowed for _, field in parts) else None


def _filled(route: Column, kind: Column, branches: dict[tuple[str, str], list[tuple[str, str | None]] | None]) -> Column:
    """Fill the template of each row's route and kind; null where there is none.

    The templates are one constant map, so the plan stays as small with thirty
    templates as with one. Fields are put in side by side, so braces inside a
    passage are never expanded.
    """
    known = {k: v for k, v in branches.items() if v is not None}
    if not known:
        return F.lit(None).cast("string")
    entries: list[Column] = []
    for (r, k), parts in known.items():
        entries.append(F.lit(f"{r}/{k}"))
        entries.append(F.array(*[
            F.struct(F.lit(text).alias("text"), F.lit(field or "").alias("field")) for text, field in parts
        ]))
    parts = F.try_element_at(F.create_map(*entries), F.concat(route, F.lit("/"), kind))
    longest = max(len(v) for v in known.values())

    def joined(found: Column) -> Column:
        pieces: list[Column] = []
        for i in range(longest):
            part = F.get(found, F.lit(i))
            value = None
            for field in KIND_FIELDS["full_prompt"]:
                cond = part["field"] == field
                value = F.when(cond, F.col(field)) if value is None else value.when(cond, F.col(field))
            pieces += [F.coalesce(part["text"], F.lit("")), F.coalesce(value, F.lit(""))]
        return F.when(found.isNotNull(), F.concat(*pieces))

    return let(parts, joined)


def inference_prompt(templates: Templates, route: Column | None = None) -> Column:
    """Prompt to answer a row; null where the route has no prompt of that kind.

    A missing route means the routing prompt itself.
    """
    route = F.coalesce(F.nullif(route if route is not None else F.col("template"), F.lit("")), F.lit("template"))
    branches = {
        (r, k): fillable(keys[k], KIND_FIELDS[k]) for r, keys in templates.items() for k in PROMPT_KINDS if k in keys
    }
    return _filled(route, prompt_kind(), branches)


def training_target(use_tools: bool = True) -> Column:
    """What the model should reply: the intermediate step where a tool takes over, else the answer."""
    target = None
    if use_tools:
        for route, field in TOOL_TARGETS.items():
            cond = F.col("template") == route
            target = F.when(cond, F.col(field)) if target is None else target.when(cond, F.col(field))
    return F.col("output") if target is None else target.otherwise(F.col("output"))


def training_prompt(templates: Templates, use_tools: bool = True, route: str | None = None) -> Column:
    """Inference prompt plus target; null for pairs of route and kind that do not exist."""
    branches = {}
    for r, kinds in TRAINING_KINDS.items():
        for k in kinds:
            if k in templates.get(r, {}):
                fields = GENERIC_FIELDS[k] if r == "generic" else KIND_FIELDS[k]
                branches[(r, k)] = fillable(templates[r][k], fields)
    at = F.lit(route) if route else F.col("template")
    return F.concat(_filled(at, prompt_kind(), branches), training_target(use_tools))


def split_by_prompt(df: DataFrame, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Rows with a prompt, and the rejected rows with a reason."""
    rejected = df.where(F.col(prompt).isNull()).withColumn(
        "reason", F.concat(F.lit("no prompt for "), F.coalesce("template", F.lit("?")), F.lit(" / "), prompt_kind())
    )
    return df.where(F.col(prompt).isNotNull()), rejected.drop(prompt)


def with_template(df: DataFrame, templates: Templates, route: str = "template") -> DataFrame:
    """Attach template text and separator by a lookup join on route and kind."""
    table = template_table(df.sparkSession, templates).withColumnsRenamed(
        {"route": "t_route", "prompt_kind": "t_kind", "text": "template_text"}
    )
    kinds = df.withColumn("prompt_kind", prompt_kind())
    found = (kinds[route] == table["t_route"]) & (kinds["prompt_kind"] == table["t_kind"])
    return kinds.join(F.broadcast(table), found, "left").drop("t_route", "t_kind")


def sectioned_text() -> Column:
    """``### Instruction:`` and then only the sections that hold text."""

    def section(title: str, c: str) -> Column:
        return F.when(present(c), F.concat(F.lit(f"### {title}:\n"), F.col(c)))

    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("### Instruction:\n"), F.coalesce("instruction", F.lit(""))),
        section("Input", "input"), section("Data", "data"), section("Response", "output"),
        section("Eval", "derivation_eval"), section("SQL", "derivation_sql"),
    )


def reasoned_shot(prompt: Column, reply: Column, gold: Column) -> Column:
    """Prompt, the reply's reasoning, and the gold answer in place of the reply's."""
    reasoning = F.split_part(reply, F.lit(ANSWER_MARK), F.lit(1))
    return F.concat(prompt, reasoning, F.lit(f"{ANSWER_MARK}: "), gold)


def few_shot_prompt(tests: DataFrame, shots: DataFrame, key: str = "sample_id", shots_found: str | None = None) -> DataFrame:
    """Add ``few_shot_prompt``: numbered shots before the row's own ``prompt``.

    ``shots`` holds ``(key, i, shot)`` with i = 1..k; a group is k rows long. Rows
    without shots keep their prompt. ``shots_found`` names a column for the number of a row's shots.
    """
    joined = (
        shots.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("i", "shot"))).alias("shots"))
        .select(
            key,
            F.array_join(
                F.transform(
                    "shots",
                    lambda s: F.concat(F.lit("Example "), s["i"].cast("string"), F.lit("\n\n"), s["shot"], F.lit("\n\n")),
                ),
                "",
            ).alias("shot_text"),
            *([F.size("shots").alias(shots_found)] if shots_found else []),
        )
    )
    opening = F.when(F.col("shot_text").isNotNull(), F.concat("shot_text", F.lit(NOW_ANSWER))).otherwise(F.lit(""))
    full = tests.join(joined, key, "left").withColumn("few_shot_prompt", F.concat(opening, F.col("prompt"))).drop("shot_text")
    return full.withColumn(shots_found, F.coalesce(shots_found, F.lit(0))) if shots_found else full


def chat_messages(templates: Templates, prompt: Column, reasoned: bool = True, route: str = "generic-3") -> Column:
    """System message (one of two wordings) and the user message."""
    system = templates[route]["system_message_cot" if reasoned else "system_message_default"]

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", prompt))


def chat_text(messages: Column) -> Column:
    """All message contents, each followed by a newline (what the budget counts)."""
    return F.concat(F.array_join(F.transform(messages, lambda m: m["content"]), "\n"), F.lit("\n"))
