"""Tables that crawls read and write."""
