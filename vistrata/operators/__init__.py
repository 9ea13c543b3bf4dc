"""DataFrame operators: profiling, association, cleaning, encoding, features, models, charts."""
