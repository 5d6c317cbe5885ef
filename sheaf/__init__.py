"""Spark-first retrieval, question answering and evaluation over whole tables of questions."""
