"""From captured bytes and pages to rows."""
