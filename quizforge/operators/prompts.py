"""Requests to chat rows and back, as expressions over a request struct (schemas.REQUEST)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lines of a request, so that rows written elsewhere can be read back.
FIELDS = {"subject": "Subject: ", "unit": "Unit: ", "topic": "Topic: ", "difficulty": "Difficulty: ", "format": "Format: "}
OBJECTIVE, OBJECTIVE_END = "Learning objective (", "): "
STIMULUS = "Include a short 'stimulus' excerpt from the passage and write a stem that asks about it."
TARGET, TARGET_END = "Target misconception: include '", "' as one of the wrong options."
AVOID, PASSAGE, RETURN = "Do not repeat these existing questions:", "Source passage:", "Return JSON with keys "
KEYS = '"choices" (object with keys A-D), "answer" (one letter), "explanation", "lo_id", "difficulty"'


def _line(name: str, r: Column) -> Column:
    return F.concat(F.lit(FIELDS[name]), r[name])


def render(r: Column) -> Column:
    """The user message of a request: one line a field, then the passage and the keys asked for."""
    stimulus, target, avoid = r["format"] == "stimulus", r["target_misconception"], F.coalesce(r["avoid"], F.array().cast("array<string>"))
    head = F.array(
        _line("subject", r), _line("unit", r), _line("topic", r), F.concat(F.lit(OBJECTIVE), r["lo_id"], F.lit(OBJECTIVE_END), r["lo_text"]), _line("difficulty", r), _line("format", r),
        F.when(stimulus, F.lit(STIMULUS)), F.when(target != "", F.concat(F.lit(TARGET), target, F.lit(TARGET_END))), F.when(F.size(avoid) > 0, F.lit(AVOID)),
    )
    keys = F.concat(F.lit('"stem", '), F.when(stimulus, F.lit('"stimulus", ')).otherwise(""), F.lit(KEYS))
    tail = F.array(F.lit(""), F.lit(PASSAGE), F.trim(r["passage"]), F.lit(""), F.concat(F.lit(RETURN), keys, F.lit(".")))
    return F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), F.transform(avoid, lambda a: F.concat(F.lit("- "), a)), tail), "\n")


def parse(t: Column) -> Column:
    """The request that a user message was rendered from."""
    head, rest = F.substring_index(t, f"\n\n{PASSAGE}\n", 1), F.element_at(F.split(t, f"\n\n{PASSAGE}\n", 2), 2)
    lines = F.split(head, "\n")

    def after(start: str, end: str = "") -> Column:
        found = F.get(F.filter(lines, lambda x: x.startswith(start)), F.lit(0))
        return F.substr(found, F.lit(len(start) + 1), F.length(found) - (len(start) + len(end)))

    both = after(OBJECTIVE)
    cut = F.instr(both, OBJECTIVE_END)
    return F.struct(
        *(after(FIELDS[k]).alias(k) for k in ("subject", "unit", "topic")), F.substr(both, F.lit(1), cut - 1).alias("lo_id"), F.substr(both, cut + len(OBJECTIVE_END)).alias("lo_text"),
        *(after(FIELDS[k]).alias(k) for k in ("difficulty", "format")), F.regexp_replace(rest, r"(?s)\n\nReturn JSON(?!.*\n\nReturn JSON).*$", "").alias("passage"), after(TARGET, TARGET_END).alias("target_misconception"),
        F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: F.substr(x, F.lit(3))).alias("avoid"),
    )


def completion(item: Column) -> Column:
    """The assistant message: keys in a fixed order, no stimulus where there is none."""
    return F.to_json(F.struct(*(item[k].alias(k) for k in ("stem", "stimulus", "choices", "answer", "explanation", "lo_id", "difficulty"))))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: str, request: Column, item: Column | None = None, shots: Column | None = None) -> Column:
    """System, shots (array of struct<request, item>) as pairs, the request and the completion if given."""
    out = [F.array(message("system", F.lit(system)))]
    if shots is not None:
        out.append(F.flatten(F.transform(shots, lambda s: F.array(message("user", render(s["request"])), message("assistant", completion(s["item"]))))))
    out.append(F.array(message("user", render(request))))
    if item is not None:
        out.append(F.array(message("assistant", completion(item))))
    return F.concat(*out)


def solver_body(stem: Column, choices: Column, stimulus: Column, passage: Column) -> Column:
    """The question as a judge sees it; the passage makes it open-book."""
    parts = F.array(F.when(passage != "", F.concat(F.lit("Passage: "), F.trim(passage))), F.when(stimulus != "", F.trim(stimulus)), F.trim(stem))
    options = F.transform(F.array_sort(F.map_keys(choices)), lambda k: F.concat(k, F.lit(". "), choices[k]))
    return F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n"), F.lit("\n"), F.array_join(options, "\n"), F.lit("\nAnswer:"))


def training_item(question: Column, choices: Column, letter: Column, explanation: Column, lo_id: Column, difficulty: Column, format_: Column, excerpt: Column) -> Column:
    """The item to train on, or null without explanation or, for a stimulus, without excerpt."""
    stimulus = format_ == "stimulus"
    low = F.concat(F.lower(F.substring(question, 1, 1)), F.substr(question, F.lit(2)))
    stem = F.when(stimulus, F.concat(F.lit("Based on the excerpt, "), low)).otherwise(question)
    item = F.struct(stem.alias("stem"), F.when(stimulus, excerpt).alias("stimulus"), choices.alias("choices"), letter.alias("answer"), explanation.alias("explanation"), lo_id.alias("lo_id"), difficulty.alias("difficulty"))
    return F.when(explanation.isNotNull() & (~stimulus | excerpt.isNotNull()), item)
