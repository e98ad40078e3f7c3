"""DataFrame in, DataFrame out; no operator runs a job by itself."""
