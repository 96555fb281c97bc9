"""Relational building blocks: scope, statistics, and the joins Spark lacks natively."""
