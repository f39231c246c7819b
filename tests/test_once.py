"""What is named in a lambda is computed for each element: nothing costly stands in one."""

from pyspark.sql import functions as F

from rasm.functions import text as tx


def lambdas(plan: str) -> list[str]:
    """The arguments of each lambda function in a plan."""
    out = []
    for part in plan.split("lambdafunction(")[1:]:
        depth = 1
        for i, x in enumerate(part):
            depth += (x == "(") - (x == ")")
            if not depth:
                out.append(part[:i])
                break
    return out


def test_texts_are_normalized_once_not_once_a_word(spark):
    df = spark.createDataFrame([("اب اب جد جد",), ("اب جد اب جد",), ("",), (None,)], "t string")
    t = F.col("t")
    got = df.select(tx.fix_rules(t).alias("f"), F.array_join(tx.tile(tx.tokens(tx.display(t))), " ").alias("b"), F.array_join(tx.collapse_repeats(tx.tokens(t)), " ").alias("r"))
    own = lambdas(got._jdf.queryExecution().analyzed().toString())
    assert own and not [x for x in own if "regexp_replace" in x or "split(" in x]
    assert [tuple(x) for x in got.collect()] == [("اب جد", "اب اب جد جد", "اب جد"), ("اب جد اب جد", "اب جد", "اب جد اب جد"), ("", "", ""), ("", "", None)]
