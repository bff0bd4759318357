"""harrow: DataFrame operators that turn crawled pages and logs into clean, merged, gated facts."""
