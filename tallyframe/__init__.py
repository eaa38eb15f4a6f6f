"""Evaluation analytics for question-answering runs, written as Spark jobs."""
