"""The eight-row sample and small helpers."""

from decimal import Decimal

from tollway.schema import LOG_SCHEMA, TierSpec

MODELS = {"swift": Decimal("0.20"), "steady": Decimal("0.60"), "expert": Decimal("1.00")}
TIERS = [
    TierSpec("fast", Decimal("0.35"), 0.5),
    TierSpec("balanced", Decimal("0.70"), 0.3),
    TierSpec("premium", Decimal("1.00"), 0.2),
]
ROWS = [
    ("general-001", "general", "What should I pack for a weekend trip?", 0.85, 0.88, 0.90),
    ("general-002", "general", "Compare three ways to plan a week\nand explain which one fits a busy parent.", 0.55, 0.78, 0.92),
    ("code-001", "code", "def add(a, b):\n    return a + b", 0.75, 0.90, 0.94),
    ("code-002", "code", "Please debug this python algorithm: ```while True: pass``` and say why it hangs.", 0.30, 0.72, 0.96),
    ("math-001", "math", "Solve the equation x + 2 = 5", 0.80, 0.86, 0.90),
    ("math-002", "math", "Give a proof that $a^2 + b^2 = c^2$ holds\nfor right triangles in geometry.", 0.35, 0.75, 0.97),
    ("science-001", "science", "Why is the sky blue according to physics?", 0.78, 0.85, 0.89),
    ("science-002", "science", "Describe how chemistry and biology meet in a cell, step by step, with examples.", 0.45, 0.77, 0.93),
]


def sample_rows():
    out = []
    for i, (example_id, domain, prompt, *quality) in enumerate(ROWS):
        by_name = dict(zip(("swift", "steady", "expert"), quality))
        models = [(m, MODELS[m], MODELS[m], Decimal(str(by_name[m]))) for m in sorted(MODELS)]
        out.append((example_id, i, prompt, domain, domain, models))
    return out


def sample_log(spark, rows=None):
    return spark.createDataFrame(rows or sample_rows(), LOG_SCHEMA)
