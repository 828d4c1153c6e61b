"""Helpers that look at physical plans."""

import re


def plan_text(df, mode="formatted"):
    execution = df._jdf.queryExecution()
    explain_mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return execution.explainString(explain_mode)


def count_nodes(df, name):
    """How often an operator occurs in the tree part of the initial plan."""
    tree = plan_text(df).split("\n\n")[0]
    tree = tree.split("== Physical Plan ==")[-1]
    return len(re.findall(rf"\b{name}\b", tree))
