"""Set-at-a-time operators: history, ratings, matrix, evaluation, resolution, quality, mutation."""
