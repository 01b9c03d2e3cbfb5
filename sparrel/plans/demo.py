"""Prints a sample plan as JSON: ``python -m sparrel.plans.demo``."""

from sparrel.plans.algebra import Query, Scan, col, i32


def sample() -> Query:
    joined = Scan("A").cross(Scan("B")).filter(("a1", "EQ", col("b1")), ("a2", "NE", col("b2")))
    return joined.filter(("b3", "GTE", i32(0))).sort("a2", ("b3", False)).project(("a1", "id"), ("b3", "value")).build()


if __name__ == "__main__":
    print(sample().to_json())
