"""Whole queries: operators composed into plans, each with the SQL that says the same."""

from corpusloom.plans import conversations, evaluation, graphics, mixing, preparation  # noqa: F401  they register their queries
