"""Market-signal analytics as Spark jobs: bars, features, costs, sizing, rules and books."""
