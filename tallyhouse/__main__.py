from tallyhouse.cli import main

main()
