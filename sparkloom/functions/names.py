"""Parts of method ids, class names and call expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def method_name(method_id: Column) -> Column:
    """The id up to its first parenthesis, after its last dot."""
    cut = F.when(F.instr(method_id, "(") > 1, F.substring_index(method_id, "(", 1)).otherwise(method_id)
    return F.when(F.instr(cut, ".") > 1, F.substring_index(cut, ".", -1)).otherwise(cut)


def app_of(method_id: Column) -> Column:
    """What stands before the colon, or `unknown`."""
    return F.when(F.instr(method_id, ":") > 1, F.substring_index(method_id, ":", 1)).otherwise("unknown")


def signature_of(method_id: Column) -> Column:
    return F.substring_index(method_id, ".", -1)


def class_of(method_id: Column) -> Column:
    """The name before the method's, without app, package and parameters; the whole where there is no dot."""
    after = F.when(F.instr(method_id, ":") > 1, F.substring(method_id, F.instr(method_id, ":") + 1, F.length(method_id))).otherwise(method_id)
    parts = F.split(F.substring_index(after, "(", 1), r"\.")
    return F.coalesce(F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(parts[0]), F.lit(""))


def simple_name(class_name: Column) -> Column:
    return F.substring_index(class_name, ".", -1)


def package_of(class_name: Column) -> Column:
    return F.when(F.instr(class_name, ".") > 0, F.regexp_replace(class_name, r"\.[^.]*$", "")).otherwise("")


def url_path(expression: Column) -> Column:
    """The path of the first http:// (else https://) address, up to a quote, else a comma, else a parenthesis; null without one."""
    at = F.when(F.instr(expression, "http://") > 0, F.instr(expression, "http://")).otherwise(F.instr(expression, "https://"))
    rest = F.substring(expression, at, F.length(expression))
    slash = F.locate("/", rest, 9)
    path = F.substring(rest, slash, F.length(rest))
    end = F.coalesce(*(F.nullif(F.instr(path, mark), F.lit(0)) for mark in '",)'))
    return F.when((at > 0) & (slash > 0), F.when(end.isNotNull(), F.substring(path, F.lit(1), end - 1)).otherwise(path))


def rpc_method(expression: Column) -> Column:
    """The called name of an expression that mentions dubbo: after the last dot, up to the parenthesis."""
    last = F.substring_index(expression, ".", -1)
    name = F.when(F.instr(last, "(") > 1, F.substring_index(last, "(", 1)).otherwise(last)
    return F.when((expression.contains("dubbo") | expression.contains("Dubbo")) & expression.rlike(r"^.+\."), name)


def half_up(x: Column) -> Column:
    """Rounded half up to one place."""
    return F.floor(x * 10 + 0.5) / 10
