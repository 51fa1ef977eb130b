from pyspark.sql import functions as F

from distillery.functions.text import teacher_prompt
from distillery.operators.generate import md5_generator
from distillery.streaming.generate import read_results, stream_generate


def test_restart_answers_only_new_files(spark, tmp_root):
    from tests.conftest import SF_SMALL

    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").filter("role = 'user'")
    src, out, ckpt = f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ckpt"
    conv.filter(F.col("conv_id") % 2 == 0).write.parquet(f"{src}/part1")
    schema = conv.schema

    def prompts(df):
        return df.select("conv_id", "turn", teacher_prompt("text").alias("prompt"))

    opts = {"recursiveFileLookup": "true"}
    assert stream_generate(spark, src, schema, prompts, md5_generator, out, ckpt, options=opts)
    first = read_results(spark, out).count()
    conv.filter(F.col("conv_id") % 2 == 1).write.parquet(f"{src}/part2")
    assert stream_generate(spark, src, schema, prompts, md5_generator, out, ckpt, options=opts)
    res = read_results(spark, out)
    assert res.count() == conv.count()
    assert first == conv.filter(F.col("conv_id") % 2 == 0).count()
    assert res.groupBy("conv_id", "turn").count().filter("count > 1").count() == 0
    assert res.filter("status != 'ok'").count() == 0
