"""What captured output and streamed replies say: test summaries, fragments put together, logged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

#: How many failures a summary shows, and how many last lines where nothing is recognised.
FAILURES, TAIL = 20, 40


def is_failure(line: Column) -> Column:
    """Lines that name a failing test, in the words of the common runners. Fixed values."""
    t = F.trim(line)
    return t.startswith("FAILED ") | t.startswith("FAIL ") | t.startswith("--- FAIL:") | t.contains("AssertionError") | t.contains("panicked at") | t.startswith("✗") | t.startswith("✕")


def is_summary(line: Column) -> Column:
    low = F.lower(line)
    return low.contains("passed") | low.contains("failed") | (low.contains("tests:") & low.contains("total"))


def summarized(logs: DataFrame, key: str, text: str, success: str) -> DataFrame:
    """(key, summary): whether the tests passed, the last line that sums up, the first FAILURES failures; where there is
    neither, the last TAIL lines.

    A log's lines go their own ways: a maximum for the summary, the first failures and the last lines by rank, so that no
    log is gathered but for the lines shown.
    """
    rows = logs.select(key, success, F.posexplode(lines(F.col(text))).alias("no", "line"))
    rows = rows.withColumn("bad", is_failure(F.col("line"))).withColumn("sums", is_summary(F.col("line")))
    facts = rows.groupBy(key).agg(F.max_by(F.when(F.col("sums"), F.trim("line")), F.when(F.col("sums"), F.col("no"))).alias("sum"), F.max("bad").alias("any"))
    shown = lambda df: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    first = rows.where("bad").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("no"))).where(F.col("r") <= FAILURES)
    failing = shown(first).select(key, F.array_join(F.transform("l.line", lambda x: F.trim(x)), "\n").alias("failing"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("no")))).where(F.col("r") <= TAIL)
    tail = shown(last).select(key, F.array_join("l.line", "\n").alias("tail"))
    j = logs.select(key, success).join(facts, key, "left").join(failing, key, "left").join(tail, key, "left")
    head = F.when(F.col(success), "TESTS PASSED\n").otherwise("TESTS FAILED\n")
    body = F.concat(head, F.coalesce(F.concat("sum", F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("\nfailing:\n"), "failing", F.lit("\n")), F.lit("")))
    bare = F.col("sum").isNull() & F.col("failing").isNull()
    return j.select(key, F.when(bare, F.concat(head, F.lit("\n(no recognizable summary line — raw output tail)\n"), F.coalesce("tail", F.lit("")))).otherwise(body).alias("summary"))


#: What a streamed reply says per record.
RECORD = "struct<error:string,choices:array<struct<delta:struct<content:string,reasoning_content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>>"


def records(chunks: DataFrame, stream: str, seq: str, data: str, prefix: str = "data:") -> DataFrame:
    """(stream, no, record): the lines of streams whose chunks are cut at any byte, and the text after their prefix.

    Chunks are binary, in order of seq. A line may lie in any number of chunks: a chunk's piece before its first break
    belongs to the line that the last break before it began. Pieces meet by the number of breaks before them, so that a stream is
    never gathered, only a line. Lines without the prefix, empty ones, and [DONE] with what follows are left out.
    """
    c = chunks.select(F.col(stream).alias("k__"), F.col(seq).alias("s"), F.hex(F.col(data)).alias("h"))
    # In hexadecimal a break is the pair 0A at an even place; pieces between breaks keep their bytes.
    pieces = F.split(F.regexp_replace("h", "(..)", "$1 "), "0A ")
    c = c.withColumn("p", pieces).withColumn("breaks", F.size("p") - 1)
    before = Window.partitionBy("k__").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("base", F.coalesce(F.sum("breaks").over(before), F.lit(0)))
    rows = c.select("k__", "s", "base", F.posexplode("p").alias("i", "piece")).withColumn("no", F.col("base") + F.col("i"))
    whole = rows.groupBy("k__", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "i", "piece"))), lambda x: x["piece"]), "").alias("h"))
    text = F.trim(F.regexp_replace(F.decode(F.unhex(F.replace("h", F.lit(" "), F.lit(""))), "UTF-8"), r"\r$", ""))
    whole = whole.withColumn("line", text).where(F.col("line").startswith(prefix))
    whole = whole.select("k__", "no", F.trim(F.substring("line", len(prefix) + 1, 2**31 - 1)).alias("record")).where("record <> ''")
    done = whole.where("record = '[DONE]'").groupBy("k__").agg(F.min("no").alias("end"))
    return whole.join(done, "k__", "left").where(F.col("end").isNull() | (F.col("no") < F.col("end"))).drop("end").withColumnRenamed("k__", stream)


def replies(recs: DataFrame, stream: str) -> DataFrame:
    """(stream, content, thinking, calls): the fragments of each reply in order. calls: (index, id, name, arguments) by index.

    Records after the first that names a reason to finish are left out; a call's last id counts, its name and arguments are
    joined, and arguments that are blank are an empty object.
    """
    r = recs.withColumnRenamed(stream, "k__").withColumn("j", F.from_json("record", RECORD))
    over = r.where(F.exists("j.choices", lambda c: c["finish_reason"].isNotNull())).groupBy("k__").agg(F.min("no").alias("end"))
    r = r.join(over, "k__", "left").where(F.col("end").isNull() | (F.col("no") <= F.col("end")))
    d = r.select("k__", "no", F.posexplode("j.choices").alias("c", "x")).select("k__", "no", "c", "x.delta.*")
    joined = lambda col: F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(col) != "", F.struct("no", "c", F.col(col).alias("v"))))), lambda x: x["v"]), ""), F.lit(""))
    said = d.groupBy("k__").agg(joined("content").alias("content"), joined("reasoning_content").alias("thinking"))
    f = d.select("k__", "no", "c", F.posexplode("tool_calls").alias("i", "t")).select("k__", "no", "c", "i", "t.index", "t.id", "t.function.name", "t.function.arguments")
    text = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("no", "c", "i", F.col(col).alias("v"))))), lambda x: x["v"]), "")
    calls = f.groupBy("k__", "index").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.struct("no", "c", "i"))).alias("id"), text("name").alias("name"), text("arguments").alias("arguments"))
    calls = calls.withColumn("arguments", F.when(F.trim("arguments") == "", "{}").otherwise(F.col("arguments")))
    per = calls.groupBy("k__").agg(F.array_sort(F.collect_list(F.struct("index", "id", "name", "arguments"))).alias("calls"))
    none = F.array().cast("array<struct<index:int,id:string,name:string,arguments:string>>")
    return said.join(per, "k__", "left").withColumn("calls", F.coalesce("calls", none)).withColumnRenamed("k__", stream)
