"""The training-data pipeline: quality rules, line dedup, near-dedup by SimHash tries and shingle similarity, mixing, packing."""

from loomgraph.llm import line_dedup, mixing, near, packing, quality
from loomgraph.llm.common import cut, noting, sweep, table
from loomgraph.llm.queries import tokenizer_path


_LEFT = {}


def stage(operator):
    """A stage clears away what the stages before it wrote for themselves: their output has been written and is ``docs`` now."""

    def run_stage(spark, docs, sf_dir):
        app = spark.sparkContext.applicationId
        left = sweep(_LEFT.get(app, []), docs)
        with noting() as made:
            out = operator(spark, docs, sf_dir)
        _LEFT[app] = left + made
        return out

    run_stage.__name__, run_stage.__doc__ = operator.__name__, operator.__doc__
    return run_stage


@stage
def rate(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.assess(docs, keep=docs.columns).where("kept").select(*docs.columns)


@stage
def drop_lines(spark, docs, sf_dir):
    """Boilerplate lines go from all documents but the first that holds them."""
    return line_dedup.dedup(docs)


@stage
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies (linked by SimHash tries, five-word shingles of similarity 0.8 or more) stays."""
    return near.dedup(docs)


@stage
def mix(spark, docs, sf_dir):
    """Documents stay as often as the mix takes them."""
    return mixing.resample(docs)


@stage
def pack(spark, docs, sf_dir):
    """Pieces with their sequences."""
    return packing.pack(docs, tokenizer_path(), keep_ids=False)


STAGES = [("quality", rate), ("lines", drop_lines), ("near_copies", drop_near_copies), ("mix", mix), ("pack", pack)]

#: Expectation-maximisation, the near-copy components and the linear program have no SQL; tests/llm/test_pipeline.py holds the chain against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        out = apply(spark, docs, sf_dir)
        with noting() as made:
            docs = cut(out)
        _LEFT[spark.sparkContext.applicationId] += made
    return STAGES[-1][1](spark, docs, sf_dir)
