"""Results in pages: each call does a bounded piece of work and tells how to go on."""
