"""DataFrame operators: features, ranking, splits, model, evaluation, frame sampling."""
