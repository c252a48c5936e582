"""Column-expression helpers: text cleaning, stemming, scores."""
