"""Polling of the HR source: changed rows since a mark, and their state and change events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import name_uuid


def changed_since(
    source: DataFrame, mark: datetime | str | None, column: str = "last_modified"
) -> DataFrame:
    """Rows modified after ``mark``; all rows when there is no mark yet.

    The comparison is pushed down to the scan.  No sort: the consumer orders by key.
    """
    return source if mark is None else source.filter(F.col(column) > F.lit(mark).cast("timestamp"))


def next_mark(source: DataFrame, column: str = "last_modified") -> datetime | None:
    """The newest modification time seen, to be the next mark.

    Taken from the data, so rows written while a poll runs are not skipped.
    """
    return source.agg(F.max(column)).first()[0]


def _event(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def employee_events(employees: DataFrame, now: Column) -> DataFrame:
    """A state row and an ``employee.updated`` row per source row, in raw-table shape.

    Source columns: employee_id, first_name, last_name, email, job_title, department,
    org_unit_id, entry_date, exit_date, active, version.
    """
    none, ts = F.lit(None), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(1).cast("bigint"))
    person = name_uuid(F.concat(F.lit("hr-employee:"), F.col("employee_id")))
    prepared = employees.select("*", version.alias("_v"), person.alias("_id"), ts.alias("_ts"))
    text = none.cast("string")
    state = _event(
        eventid=text, eventtype=text, employeeid=F.col("_id"), externalid=F.col("employee_id"),
        firstname=F.col("first_name"), lastname=F.col("last_name"), email=F.col("email"),
        jobtitle=F.col("job_title"), department=F.col("department"), orgunitid=F.col("org_unit_id"),
        entrydate=F.col("entry_date").cast("string"), exitdate=F.col("exit_date").cast("string"),
        active=F.coalesce("active", F.lit(True)), deleted=F.lit(False), version=F.col("_v"),
        timestamp=F.col("_ts"),
    )
    change = _event(
        eventid=name_uuid(F.concat_ws(":", "_id", F.col("_v").cast("string"))),
        eventtype=F.lit("employee.updated"), employeeid=F.col("_id"),
        externalid=F.col("employee_id"), firstname=text, lastname=text, email=text, jobtitle=text,
        department=text, orgunitid=text, entrydate=text, exitdate=text,
        active=none.cast("boolean"), deleted=none.cast("boolean"), version=none.cast("bigint"),
        timestamp=F.col("_ts"),
    )
    return prepared.select(F.inline(F.array(state, change)))


def org_unit_events(units: DataFrame, now: Column) -> DataFrame:
    """A state row and an ``org-unit.updated`` row per source row, in raw-table shape.

    Source columns: org_unit_id, name, parent_org_unit_id, manager_employee_id, level,
    active, version.
    """
    none, ts = F.lit(None), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(1).cast("bigint"))
    text = none.cast("string")
    unit = F.col("org_unit_id")
    state = _event(
        eventid=text, eventtype=text, orgunitid=unit, externalid=unit, name=F.col("name"),
        parentorgunitid=F.col("parent_org_unit_id"), manageremployeeid=F.col("manager_employee_id"),
        level=F.coalesce(F.col("level").cast("int"), F.lit(1)),
        active=F.coalesce("active", F.lit(True)), deleted=F.lit(False), version=version,
        timestamp=ts,
    )
    change = _event(
        eventid=name_uuid(F.concat_ws(":", unit, version.cast("string"))),
        eventtype=F.lit("org-unit.updated"), orgunitid=unit, externalid=unit, name=text,
        parentorgunitid=text, manageremployeeid=text, level=none.cast("int"),
        active=none.cast("boolean"), deleted=none.cast("boolean"), version=none.cast("bigint"),
        timestamp=ts,
    )
    return units.select(F.inline(F.array(state, change)))
