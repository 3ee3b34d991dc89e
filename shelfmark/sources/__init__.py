"""Tables in and out: works CSV, captured responses, provider records, payload files."""
