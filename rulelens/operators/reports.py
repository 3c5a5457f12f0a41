"""Report lines, report bodies and status lines of finished tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.functions.text import clip, first_sentence
from rulelens.functions.verdicts import percent
from rulelens.operators.numbering import GROUP_ROWS, number_within

# The words of a report.
SECTIONS = ("No cumplido", "Pendiente de revisión", "Superado")
NO_REMARK = "Sin observaciones."
APPROVED, NOT_APPROVED = "APROBADO", "NO APROBADO"
STATUS_APPROVED, STATUS_CHANGES = "Aprobado", "Cambios requeridos"
FOOTER = "_Generado automáticamente_"
STATUS_CHARS = 140
PART_LINES = 1000


def section_of(verdict: Column) -> Column:
    """0 for fails and unknown verdicts, 1 for partials, 2 for passes."""
    return F.when(verdict == "pass", 2).when(verdict == "partial", 1).otherwise(0)


def report_lines(evaluated: DataFrame, classify_by: str = "final_verdict") -> DataFrame:
    """Number the rules of a task over all sections: fails, then partials, then passes, in rule order.

    The number inside a section of a huge task is found per block of rules, so that it is not one window.
    """
    marked = evaluated.withColumn("section", section_of(F.col(classify_by)))
    numbered = number_within(
        marked,
        ["task_id"],
        [F.col("section"), F.col("rule_idx")],
        F.struct("section", F.floor(F.col("rule_idx") / 1000)),
        "_n",
        split_above=GROUP_ROWS,
    )
    remark = F.when(F.col("section") == 2, "").otherwise(first_sentence(F.col("explanation")))
    return (
        numbered.withColumn("line_no", (F.col("_n") + 1).cast("bigint"))
        .withColumn("remark", F.when(remark == "", F.lit(NO_REMARK)).otherwise(remark))
        .drop("_n")
    )


def line_text(line: Column, first_of_section: Column) -> Column:
    """Markdown of one rule, with the heading of its section before the first one."""
    title = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), line["section"] + 1)
    heading = F.when(first_of_section, F.concat(F.lit("\n#### "), title, F.lit("\n\n"))).otherwise("")
    tag = F.when(line["section"] == 0, "<details open>").otherwise("<details>")
    return F.concat(
        heading,
        tag,
        F.lit("\n<summary>"),
        line["line_no"].cast("string"),
        F.lit(". "),
        line["rule"],
        F.lit("</summary>\n\n"),
        line["remark"],
        F.lit("\n\n</details>\n"),
    )


def header_text() -> Column:
    """Title and result line; needs eval_no, approved, score and approval_threshold."""
    label = F.when(F.col("approved"), APPROVED).otherwise(NOT_APPROVED)
    return F.concat(
        F.lit("## Informe de evaluación #"),
        F.col("eval_no").cast("string"),
        F.lit("\n\n**Resultado: "),
        label,
        F.lit("** — "),
        percent(F.col("score")).cast("string"),
        F.lit("% de normas superadas (mínimo: "),
        percent(F.col("approval_threshold")).cast("string"),
        F.lit("%)\n\n---"),
    )


def report_bodies(tasks: DataFrame, lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """One Markdown body per task ``(task_id, eval_no, approved, score, approval_threshold)``.

    A task with more than ``part_lines`` rules gets its report in numbered parts, so that no body
    grows without bound; header and footer go to the first and the last part. ``lines`` is read
    twice, so pass a stored table. They are shuffled once, by task and part; the tasks and the bounds of their sections come to the parts.
    """
    sizes = lines.groupBy("task_id", "section").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last")
    )
    parts = (
        lines.filter("task_id is not null and section is not null")
        .withColumn("part", F.floor((F.col("line_no") - 1) / part_lines))
        .groupBy("task_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "section", "rule", "remark"))).alias("_lines"))
    )
    totals = sizes.groupBy("task_id").agg(
        F.floor((F.max("last") - 1) / part_lines).alias("_last_part"),
        F.collect_list(F.when(F.col("section").isNotNull(), F.struct("section", "first", "last"))).alias("_bounds"),
    )
    placed = tasks.join(totals, "task_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last_part", F.lit(0)))))
    # a part without lines is that of a task without any
    whole = placed.join(parts, ["task_id", "part"], "left").filter(F.col("_lines").isNotNull() | F.col("_last_part").isNull())

    def text(line: Column) -> Column:
        bound = F.filter("_bounds", lambda b: b["section"] == line["section"])[0]
        end = F.when(line["line_no"] == bound["last"], "\n---").otherwise("")
        return F.concat(line_text(line, line["line_no"] == bound["first"]), end)

    return whole.select(
        "task_id",
        "part",
        F.concat_ws(
            "\n",
            F.when(F.col("part") == 0, header_text()),
            F.array_join(F.transform("_lines", text), "\n"),
            F.when(F.col("part") == F.coalesce("_last_part", F.lit(0)), F.lit(FOOTER)),
        ).alias("body"),
    )


def status_lines(scored: DataFrame) -> DataFrame:
    """State and description of the commit status, at most 140 characters."""
    label = F.when(F.col("approved"), STATUS_APPROVED).otherwise(STATUS_CHANGES)
    text = F.concat(
        label,
        F.lit(" — "),
        percent(F.col("score")).cast("string"),
        F.lit("% (umbral "),
        percent(F.col("approval_threshold")).cast("string"),
        F.lit("%)"),
    )
    return scored.select(
        "task_id",
        F.when(F.col("approved"), "success").otherwise("failure").alias("state"),
        clip(text, STATUS_CHARS).alias("description"),
    )


def evaluation_totals(tasks: DataFrame) -> DataFrame:
    """The number printed in a report: how many evaluations its pull request has."""
    counts = tasks.groupBy("repository_full_name", "pr_number").agg(F.count("*").alias("eval_no"))
    return tasks.filter(F.col("pr_number").isNotNull()).join(counts, ["repository_full_name", "pr_number"])
