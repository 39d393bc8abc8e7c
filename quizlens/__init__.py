"""quizlens: build and judge multiple-choice question sets as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
builder) so Catalyst sees one declarative plan per job.
"""

__version__ = "0.1.0"
