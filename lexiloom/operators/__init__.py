"""DataFrame jobs: ordered folds, chunking, matching, collisions, reviews, metrics and study analytics."""
