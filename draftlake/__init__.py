"""Spark-first analytics for collections of project documents and measured plans."""
