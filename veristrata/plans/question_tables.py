"""Plans and routes for a table of questions: each rule of one question as a table function, so that tasks plan the
questions of their partitions and none goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import
from .algebra import Refused
from .language import Entry, Resolver, parse, route
from .lexical import draft_plan, question_objects
from .topics import FORBIDDEN_TOPICS


def _listed(group) -> str:
    return f"{group.kind}:{group.identifier or ' '.join(group.terms)}"


class _Plans:
    def eval(self, question: str) -> Iterator[tuple]:
        draft = draft_plan(question or "")
        yield draft.status, [_listed(g) for g in draft.groups], list(draft.warnings)


class _Objects:
    def eval(self, question: str) -> Iterator[tuple]:
        try:
            for place, obj in enumerate(question_objects(question or "")):
                yield place, [_listed(g) for g in obj["groups"]], obj["context"], None
        except Refused as refused:
            yield None, [], [], refused.code


class _Routes:
    def eval(self, question: str) -> Iterator[tuple]:
        way, rest = route(question or "", list(FORBIDDEN_TOPICS))
        yield way, None if way == "refused" else rest, rest if way == "refused" else None


def _each(questions: DataFrame, question: str, handler: type, schema: str) -> DataFrame:
    """Short questions in few files would be planned by few tasks, so they are dealt to all."""
    spark = questions.sparkSession
    workers_import(spark)
    rule = F.udtf(handler, returnType=schema)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return questions.repartition(tasks).lateralJoin(rule(F.col(question).outer()))


def plan_questions(questions: DataFrame, question: str) -> DataFrame:
    """``questions`` with ``status, groups, warnings``: one row a question. A null question is an empty one."""
    return _each(questions, question, _Plans, "status string, groups array<string>, warnings array<string>")


def object_questions(questions: DataFrame, question: str) -> DataFrame:
    """``questions`` with ``object, groups, context, code``: one row an object, or one with the refusal's code."""
    return _each(questions, question, _Objects, "object int, groups array<string>, context array<string>, code string")


def route_questions(questions: DataFrame, question: str) -> DataFrame:
    """``questions`` with ``route, clause, code``: one row a question, with the clause to search for or a refusal's code."""
    return _each(questions, question, _Routes, "route string, clause string, code string")


def parse_questions(questions: DataFrame, question: str, release: str, entries: Sequence[Entry]) -> DataFrame:
    """``questions`` with ``intent, filters, metric, code``: the controlled-English plan of each, or its refusal's code.
    ``entries``: the names that questions may use (bounded, as one resolver's are)."""

    class _Parsed:
        def __init__(self):
            self.resolver = Resolver(list(entries))

        def eval(self, asked: str) -> Iterator[tuple]:
            try:
                found = parse(asked or "", release, self.resolver)
                yield found.intent, [type(f).__name__ for f in found.filters], found.metric, None
            except Refused as refused:
                yield None, [], None, refused.code

    return _each(questions, question, _Parsed, "intent string, filters array<string>, metric string, code string")
