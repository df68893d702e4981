"""Working memory as a struct column (M14, T20): task, plan pointer, variables, items; and its text, snapshot and restore."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STATE = "struct<active_task:string,plan:array<string>,step:int,status:string,vars:map<string,string>,items:array<struct<kind:string,content:string,source:string,priority:int,ts:double>>>"
_FIELDS = ("active_task", "plan", "step", "status", "vars", "items")


def _with(state: Column, **new) -> Column:
    return F.struct(*[new.get(f, state[f]).alias(f) for f in _FIELDS]).cast(STATE)


def empty() -> Column:
    return F.from_json(F.lit('{"plan":[],"step":0,"vars":{},"items":[]}'), STATE)


def set_task(state: Column, goal: Column, plan: Column) -> Column:
    return _with(state, active_task=goal, plan=plan, step=F.lit(0), status=F.lit("in_progress"), vars=F.create_map().cast("map<string,string>"))


def advance(state: Column) -> Column:
    """The pointer moves by one, whichever step was done."""
    return _with(state, step=F.coalesce(state["step"], F.lit(0)) + 1)


def set_var(state: Column, key: Column, value: Column) -> Column:
    others = F.map_filter(F.coalesce(state["vars"], F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return _with(state, vars=F.map_concat(others, F.create_map(key, value)))


def complete_task(state: Column) -> Column:
    """Nothing is active any more; take a snapshot before."""
    return empty()


def snapshot(state: Column) -> Column:
    return F.to_json(state)


def restore(text: Column) -> Column:
    return F.coalesce(F.from_json(text, STATE), empty())


def render(state: Column) -> Column:
    mark = lambda i: F.when(i < state["step"], "x").when(i == state["step"], ">").otherwise(" ")
    head = F.concat(F.lit("Active task: "), state["active_task"], F.lit(" (status: "), F.coalesce(state["status"], F.lit("None")), F.lit(")"))
    plan = F.transform(state["plan"], lambda p, i: F.concat(F.lit("  ["), mark(i), F.lit("] "), p))
    pairs = F.transform(F.array_sort(F.map_entries(state["vars"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    with_vars = F.when(F.size(pairs) > 0, F.concat(F.lit("  vars: "), F.array_join(pairs, ", ")))
    label = lambda x: F.when(F.coalesce(x["source"], F.lit("")) != "", F.concat_ws(":", x["kind"], x["source"])).otherwise(x["kind"])
    items = F.transform(state["items"], lambda x: F.concat(F.lit("- ("), label(x), F.lit(") "), x["content"]))
    task = F.when(state["active_task"].isNotNull(), F.concat_ws("\n", head, F.when(F.size(plan) > 0, F.array_join(plan, "\n")), with_vars))
    return F.concat_ws("\n", task, F.when(F.size(items) > 0, F.array_join(items, "\n")))
