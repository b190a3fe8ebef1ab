from citewerk.cli import main

main()
