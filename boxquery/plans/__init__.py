"""Physical plans for counting and finding the rows inside boxes."""
