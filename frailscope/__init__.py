"""Frailty-index analytics over OMOP clinical tables, written as Spark DataFrame operators."""
