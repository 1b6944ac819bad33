"""quizmill: Spark jobs that turn a corpus of books into a passage-backed question bank."""
