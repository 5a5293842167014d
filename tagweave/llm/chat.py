"""Chat formatting by schema fingerprints.

A record's nested field paths, with types and list marks, are hashed; the hash
selects a declarative mapping that says where turns, roles and texts stand.
Prompt/response pairs, instruction/input/output rows and message lists come
out as the same canonical turns. Unknown fingerprints go to the mapping of the
largest known set of paths that the record contains, or else give no turns.

Turns are written in the template <s>[INST] user [/INST] assistant </s> with
a mark for each turn. Control strings inside texts are escaped reversibly: a
backslash goes before each backslash, angle and square bracket.

A conversation's rows stay apart: each is a record of one turn, formatted by
itself, and the conversation is what its records come to one after the other.
So a conversation of any length goes through one task as a sorted stream, and
no row, record or list holds it whole; its digests are taken as it goes by.

Defined results: null texts are empty; null roles are 'user' and null turn
numbers 0; roles are kept as given, but that layouts with names of their own
for them (from, say, bots) have these mapped; turns with the same number are
ordered by role, then text; texts of any length are kept whole; repeated rows
are repeated turns; rows without a conversation's id are one conversation; an
empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, modest_batches, partitions

#: Marks that open and close a turn. Roles without marks of their own carry their name.
OPEN = {"user": "<s>[INST] ", "assistant": "<s>[OUT] ", "system": "<s>[SYS] "}
CLOSE = {"user": " [/INST]</s>", "assistant": " [/OUT]</s>", "system": " [/SYS]</s>"}
TURN = re.compile(r"<s>\[(INST|OUT|SYS|ROLE=((?:[^\\\]\[<>]|\\.)*))\] ((?:[^\\\]\[<>]|\\.)*) \[/(?:INST|OUT|SYS|ROLE)\]</s>", re.S)
ROLE_OF = {"INST": "user", "OUT": "assistant", "SYS": "system"}


@dataclass(frozen=True)
class Mapping:
    """paths: a record's field paths. turns: (role or role's path, text's path); messages: the list that the paths stand in, if any; own_roles: whether its roles are the canonical ones already."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    messages: str = ""
    own_roles: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint_paths(self.paths)


def fingerprint_paths(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("prompt_response", ("prompt:string", "response:string"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt:string", "completion:string"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question:string", "answer:string"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction:string", "output:string"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction:string", "input:string", "output:string"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("messages", ("messages[].role:string", "messages[].content:string"), (("=role", "content"),), "messages"),
    Mapping("conversations", ("conversations[].from:string", "conversations[].value:string"), (("=from", "value"),), "conversations"),
    Mapping("rows", ("turns[].turn:number", "turns[].role:string", "turns[].text:string"), (("=role", "text"),), "turns", True),
)
#: Names of roles in foreign layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths with their types; nulls count as strings, list items share a path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    if isinstance(value, bool):
        return {f"{at}:bool"}
    return {f"{at}:{'number' if isinstance(value, (int, float)) else 'string'}"}


def select_mapping(record: dict, mappings=MAPPINGS) -> Mapping | None:
    paths = field_paths(record)
    mark = fingerprint_paths(paths)
    for m in mappings:
        if m.fingerprint == mark:
            return m
    fits = [m for m in mappings if set(m.paths) <= paths]
    return max(fits, key=lambda m: (len(m.paths), m.name), default=None)


def canonical_turns(record: dict, mappings=MAPPINGS) -> list[tuple[str, str]]:
    m = select_mapping(record, mappings)
    if m is None:
        return []
    out = []
    for item in record[m.messages] if m.messages else [record]:
        for role, path in m.turns:
            text = "\n".join(x for x in (item.get(p) or "" for p in path.split("+")) if x or "+" not in path)
            role = (item.get(role[1:]) if role.startswith("=") else role) or "user"
            out.append((role if m.own_roles else ROLE_NAMES.get(role, role), text))
    return out


def escape(text: str) -> str:
    return re.sub(r"[\\<>\[\]]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def write_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans that carry loss: assistants' escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body, head = escape(text), OPEN.get(role, f"<s>[ROLE={escape(role)}] ")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + CLOSE.get(role, " [/ROLE]</s>"))
        at += len(parts[-1])
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """What write_turns() was given."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((ROLE_OF.get(m[1]) or unescape(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after turns")
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>, layout string"


def format_records(records: DataFrame, *, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """Records, as JSON in any known layout, formatted, in the order they come in: FORMATTED. Records that can't be read or mapped have a null text and layout."""

    def work(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                try:
                    record = json.loads(x) if x is not None else None
                except ValueError:
                    record = None
                m = select_mapping(record) if isinstance(record, dict) else None
                text, spans = write_turns(canonical_turns(record)) if m else (None, [])
                rows.append((text, [{"start": a, "end": b} for a, b in spans], m.name if m else None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), SPANS, pa.string()))]
            yield pa.record_batch([batch.column(0), *columns], ["conv_id", "formatted", "loss_spans", "layout"])

    modest_batches(records.sparkSession)
    return records.select(column(id_col).cast("long").alias("conv_id"), column(json_col).alias("record")).mapInArrow(work, FORMATTED)


def gather(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, record): a JSON record a turn, in the 'rows' layout. A conversation's records follow each other in one partition."""
    turn, role, text = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")), F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    told = rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text")).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return told.select("conv_id", F.to_json(F.struct(F.array(F.struct("turn", "role", "text")).alias("turns"))).alias("record"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"
DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts read back as; those of one conversation follow each other and are its parts."""

    def work(batches):
        conv, said, loss, counts, layout = None, None, None, [0, 0, 0], None

        def row():
            return (conv, counts[0], said.hexdigest(), counts[1], loss.hexdigest(), counts[2], layout)

        for batch in batches:
            done = []
            for number, text, spans, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if said is None or number != conv:
                    if said is not None:
                        done.append(row())
                    conv, said, loss, counts, layout = number, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], own
                turns, under = read_turns(text or ""), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for r, t in turns:
                    said.update(encoded(f"{r}\n{t}\n"))
                loss.update(encoded(under))
                counts = [counts[0] + len(turns), counts[1] + len(under), counts[2] + len(text or "")]
            if done:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), DIGEST_TYPES)], [x.split()[0] for x in DIGEST.split(", ")])
        if said is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row(), DIGEST_TYPES)], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(work, DIGEST)


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def sha(text: str) -> str:
    return hashlib.sha256(encoded(text)).hexdigest()
