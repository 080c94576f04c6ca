"""A reviewer's session over the queue: each decision goes to the log as soon as it is made. Who asks and shows is passed in, so a
terminal, a page or a test can drive it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.fuzzy import token_sort_ratio_column
from ..schemas import DECISIONS, EDITABLE, ENTITY_TYPES
from ..sources.files import read_decisions
from .curate import append_decisions, cards, chunks_of, now, queue, replay, suggestions

MENU = "(a)ccept (e)dit (r)eject (m)erge (s)kip (v)iew (u)ndo (q)uit"
#: A "-" takes the value of one of these away.
MAY_BE_EMPTY = ("bearer", "applies_to")
_FIELDS = DECISIONS.removeprefix("seq long, ")


def waiting(records: DataFrame, log: str, redo: bool = False, verdicts: list[str] | None = None) -> DataFrame:
    """Records (of curate.keyed()) to review, most urgent first: those without a decision, or all with redo; verdicts keeps some, "none" being those
    that no critic has judged."""
    state = replay(read_decisions(records.sparkSession, log))
    out = queue(records, state.where("false") if redo else state)
    return out if not verdicts else out.where(F.coalesce("critic_verdict", F.lit("none")).isin([v.lower() for v in verdicts]))


def edited(record: Row, ask: Callable[[str], str]) -> dict[str, list[str | None]]:
    """The changed fields, as field: [old, new]. An empty answer keeps a value; an entity type that there is not is asked for again."""
    out = {}
    for name in EDITABLE:
        old = record[name]
        new = ask(f"{name} [{old or ''}]: ").strip()
        while name == "entity_type" and new and new not in ENTITY_TYPES:
            new = ask(f"{name}, one of {', '.join(ENTITY_TYPES)}: ").strip()
        value = old if not new else None if new == "-" and name in MAY_BE_EMPTY else new
        if value != old:
            out[name] = [old, value]
    return out


def merge_target(record: Row, records: DataFrame, ask: Callable[[str], str], show: Callable[[str], None]) -> str | None:
    """The id of the record to merge into, picked among the most alike; None if none is."""
    found = suggestions(records, records.where(F.col("id") == record["id"]), token_sort_ratio_column).orderBy("rank").collect()  # a few rows
    for r in found:
        show(f"{r['rank']}: {r['term']} ({r['entity_type']}, {r['score']:.0f})")
    choice = ask("merge into number, or nothing: ").strip()
    return next((r["id"] for r in found if str(r["rank"]) == choice), None)


def session(
    records: DataFrame,
    log: str,
    reviewer: str,
    ask: Callable[[str], str],
    show: Callable[[str], None],
    chunks: DataFrame | None = None,
    redo: bool = False,
    verdicts: list[str] | None = None,
) -> Counter:
    """Asks for a decision on one record after the other until the queue or the reviewer ends, and returns how many of each kind were made.
    chunks (chunk_id, text) is what (v)iew shows. Records come to the driver one at a time."""
    spark, made = records.sparkSession, Counter()
    coming = waiting(records, log, redo, verdicts).toLocalIterator()
    seen: list[Row] = []
    history: list[int] = []
    at = 0

    def write(record: Row, action: str, **more) -> None:
        row = {k.split()[0]: None for k in _FIELDS.split(", ")} | {
            k: record[k] for k in ("id", "term", "entity_type", "critic_verdict")
        } | {"reviewer": reviewer, "action": action} | more
        row["timestamp"] = spark.range(1).select(now()).first()[0]
        append_decisions(spark.createDataFrame([tuple(row.values())], ", ".join(x for x in _FIELDS.split(", "))), log)
        made[action] += 1

    while True:
        if at == len(seen):
            if (record := next(coming, None)) is None:
                if not seen:
                    show("Nothing to review.")
                return made
            seen.append(record)
        record = seen[at]
        show(cards(records.where(F.col("id") == record["id"])).first()["card"])
        choice = ask(f"{MENU}: ").strip().lower()
        if choice == "q":
            return made
        if choice == "v" and chunks is not None:
            for r in chunks_of(records.where(F.col("id") == record["id"]), chunks).orderBy("place").collect():
                show(r["text"] if r["text"] is not None else f"There is no chunk {r['chunk_id']}.")
        elif choice == "u" and history:
            at = history.pop()
            write(seen[at], "undo")
        elif choice == "s":
            at += 1
        elif choice in ("a", "e", "r", "m"):
            if choice == "a":
                write(record, "accept")
            elif choice == "e":
                changes = edited(record, ask)
                write(record, "edit", changes=changes) if changes else write(record, "accept")
            elif choice == "r":
                write(record, "reject", reason=ask("reason: ").strip() or None)
            elif (target := merge_target(record, records, ask, show)) is not None:
                write(record, "merge", target=target)
            else:
                continue
            history.append(at)
            at += 1
